"""Elements of lines, quads and hexes as Morton ids: column expressions only.

An element is its level and the id of that level: the bits of its integer coordinates (0 to 2^level - 1), interleaved with x lowest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def shl(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftleft", x.cast("long"), (n if isinstance(n, Column) else F.lit(n)).cast("int"))


def shr(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftright", x.cast("long"), (n if isinstance(n, Column) else F.lit(n)).cast("int"))


def _stages(dim: int) -> list[tuple[int, int]]:
    """(shift, mask) of each halving that spreads the bits of a coordinate `dim` places apart."""
    width, out = 32 if dim == 2 else 21, []
    size = 32
    while size >= 1:
        mask = 0
        for bit in range(width):
            at = bit // size * size * dim + bit % size
            if at < 63:
                mask |= 1 << at
        out.append((size * (dim - 1), mask))
        size //= 2
    return out


def spread(x: Column, dim: int) -> Column:
    if dim == 1:
        return x.cast("long")
    stages = _stages(dim)
    x = x.cast("long").bitwiseAND(_long(stages[0][1]))
    for shift, mask in stages[1:]:
        x = x.bitwiseOR(shl(x, shift)).bitwiseAND(_long(mask))
    return x


def gathered(x: Column, dim: int) -> Column:
    """Every dim-th bit of x, from the lowest on."""
    if dim == 1:
        return x.cast("long")
    stages = _stages(dim)
    x = x.cast("long").bitwiseAND(_long(stages[-1][1]))
    for (shift, _), (_, mask) in zip(reversed(stages[1:]), reversed(stages[:-1]), strict=True):
        x = x.bitwiseOR(shr(x, shift)).bitwiseAND(_long(mask))
    return x


def encode(*coords: Column) -> Column:
    out = None
    for k, c in enumerate(coords):
        part = shl(spread(c, len(coords)), k)
        out = part if out is None else out.bitwiseOR(part)
    return out


def decode(id: Column, dim: int) -> list[Column]:
    return [gathered(shr(id, k), dim) for k in range(dim)]


def parent(id: Column, dim: int) -> Column:
    return shr(id, dim)


def child(id: Column, i: Column | int, dim: int) -> Column:
    return shl(id, dim).bitwiseOR((i if isinstance(i, Column) else F.lit(i)).cast("long"))


def child_id(id: Column, dim: int) -> Column:
    return id.bitwiseAND(_long((1 << dim) - 1))


def sibling(id: Column, i: Column | int, dim: int) -> Column:
    return child(parent(id, dim), i, dim)


def ancestor(id: Column, level: Column | int, to: Column | int, dim: int) -> Column:
    """The id at level `to`, at or above `level`."""
    up = (level if isinstance(level, Column) else F.lit(level)) - to
    return shr(id, up * dim)


def first_descendant(id: Column, level: Column | int, to: Column | int, dim: int) -> Column:
    down = (to if isinstance(to, Column) else F.lit(to)) - level
    return shl(id, down * dim)


def last_descendant(id: Column, level: Column | int, to: Column | int, dim: int) -> Column:
    return first_descendant(id + 1, level, to, dim) - 1


def is_ancestor(id: Column, level: Column, other: Column, other_level: Column, dim: int) -> Column:
    """Whether the first element is an ancestor of the second, or is it."""
    return (level <= other_level) & (shr(other, F.greatest(other_level - level, F.lit(0)) * dim) == id)


def nca_level(a: Column, a_level: Column, b: Column, b_level: Column, dim: int) -> Column:
    """Level of the nearest common ancestor of two elements."""
    least = F.least(a_level, b_level)
    differ = shr(a, (a_level - least) * dim).bitwiseXOR(shr(b, (b_level - least) * dim))
    digits = F.when(differ == 0, F.lit(0)).otherwise(F.ceil(F.length(F.bin(differ)) / dim).cast("int"))
    return least - digits


def faces(dim: int) -> range:
    """Face 2k looks down axis k, face 2k + 1 up."""
    return range(2 * dim)


def face_neighbour(coords: Sequence[Column], face: Column) -> list[Column]:
    """Coordinates of the element of the same level across a face; outside the tree they are -1 or 2^level."""
    step = F.when(face % 2 == 0, F.lit(-1)).otherwise(F.lit(1))
    axis = F.floor(face / 2)
    return [c + F.when(axis == k, step).otherwise(F.lit(0)) for k, c in enumerate(coords)]


def inside(coords: Sequence[Column], level: Column) -> Column:
    size = shl(F.lit(1), level)
    out = F.lit(True)
    for c in coords:
        out = out & (c >= 0) & (c < size)
    return out


def dual_face(face: Column) -> Column:
    return face.bitwiseXOR(F.lit(1).cast("int"))


def children_at_face(face: int, dim: int) -> list[int]:
    return [i for i in range(1 << dim) if i >> face // 2 & 1 == face % 2]


def corner(coords: Sequence[Column], level: Column, i: int) -> list[Column]:
    """Reference coordinates, 0 to 1, of corner i."""
    size = shl(F.lit(1), level).cast("double")
    return [(c + (i >> k & 1)) / size for k, c in enumerate(coords)]
