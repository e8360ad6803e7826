import numpy as np
import pytest

from foliate.llm.eliasfano import EliasFano, Trie


@pytest.mark.parametrize("seed", range(8))
def test_access_and_successor(seed):
    rng = np.random.default_rng(seed)
    values = np.sort(rng.integers(0, [3, 100, 1 << 20, 1 << 48][seed % 4], [1, 5, 700, 5000][seed // 2], dtype=np.uint64))
    ef = EliasFano(values)
    assert (ef[np.arange(len(values))] == values).all()
    x = np.concatenate([values, values + np.uint64(1), rng.integers(0, 1 << 49, 500, dtype=np.uint64), [np.uint64(0)]])
    assert (ef.successor(x) == np.searchsorted(values, x)).all()


def test_trie_finds_exactly_what_it_holds():
    rng = np.random.default_rng(1)
    contexts = np.unique(rng.integers(0, 1 << 48, 300, dtype=np.uint64))
    runs = [np.unique(rng.integers(0, 1 << 32, rng.integers(1, 9), dtype=np.uint64)) for _ in contexts]
    pointers = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    flat = np.concatenate(runs)
    trie = Trie(contexts, pointers, flat, np.arange(len(contexts), dtype=np.uint16), np.arange(len(flat), dtype=np.uint16))
    assert (trie.find_contexts(contexts) == np.arange(len(contexts))).all()
    assert (trie.find_contexts(contexts + np.uint64(1)) == -1).sum() >= len(contexts) - 1
    at = np.repeat(np.arange(len(contexts)), np.diff(pointers))
    assert (trie.find_successors(at, flat) == np.arange(len(flat))).all()
    missing = trie.find_successors(np.roll(at, 10), flat)
    assert (missing == -1).sum() > len(flat) * 0.9 and (trie.find_successors(np.full(3, -1), flat[:3]) == -1).all()
