"""Reference shapes of the element classes, and the refinement tables that follow from them.

Every tree lives in the unit cube of its dimension. An element of a level is one of a few shapes ("types") in one cell of the grid of
that level: boxes fill a cell; a cell holds two triangles, or six tets around its diagonal, or two prisms; a pyramid tree has in a cell
two pyramids and two tets, or, inside a larger tet, tets only. The children of an element are the shapes of half the size whose centre lies
in it, numbered by their cell and then by their type. All tables below are worked out from that rule; only corners and faces are given.
"""

from __future__ import annotations

from fractions import Fraction
from functools import cache
from itertools import product

from .eclass import HEX, LINE, PRISM, PYRAMID, QUAD, TET, TRIANGLE, VERTEX

Point = tuple[int, ...]

DIM = {VERTEX: 0, LINE: 1, QUAD: 2, TRIANGLE: 2, HEX: 3, TET: 3, PRISM: 3, PYRAMID: 3}

# The corners of each face, by class.
FACES = {
    VERTEX: [],
    LINE: [[0], [1]],
    QUAD: [[0, 2], [1, 3], [0, 1], [2, 3]],
    TRIANGLE: [[1, 2], [0, 2], [0, 1]],
    HEX: [[0, 2, 4, 6], [1, 3, 5, 7], [0, 1, 4, 5], [2, 3, 6, 7], [0, 1, 2, 3], [4, 5, 6, 7]],
    TET: [[1, 2, 3], [0, 2, 3], [0, 1, 3], [0, 1, 2]],
    PRISM: [[1, 2, 4, 5], [0, 2, 3, 5], [0, 1, 3, 4], [0, 1, 2], [3, 4, 5]],
    PYRAMID: [[0, 2, 4], [1, 3, 4], [0, 1, 4], [2, 3, 4], [0, 1, 2, 3]],
}
# The faces of a pyramid that stands on its tip.
FACES_DOWN = [[2, 3, 4], [0, 1, 4], [1, 3, 4], [0, 2, 4], [0, 1, 2, 3]]
# Faces of equal sense have their corners in the same turn, seen from outside.
SENSE = {LINE: [0, 0], QUAD: [0, 0, 0, 0], TRIANGLE: [0, 0, 0], HEX: [0, 1, 1, 0, 0, 1], TET: [0, 1, 0, 1], PRISM: [1, 0, 1, 0, 1], PYRAMID: [0, 1, 1, 0, 0]}
# The order in which classes of a dimension are compared.
RANK = {VERTEX: 0, LINE: 0, TRIANGLE: 0, QUAD: 1, TET: 0, HEX: 1, PRISM: 2, PYRAMID: 3}
#: Types of pyramids in a pyramid tree: upright, and on the tip; types below are tets.
UP, DOWN = 6, 7
#: Bits of one level in an element's id.
BITS = {VERTEX: 0, LINE: 1, QUAD: 2, TRIANGLE: 2, HEX: 3, TET: 3, PRISM: 3, PYRAMID: 4}
#: Type of the root.
ROOT = {c: UP if c == PYRAMID else 0 for c in DIM}


def _axes(kind: int) -> tuple[int, int, int]:
    """The axes along which the corners of a tet follow each other: of its points, coordinates fall in this order."""
    first = kind // 2
    second = (first + (1 if kind % 2 else 2)) % 3
    return first, second, 3 - first - second


def _unit(*axes: int) -> Point:
    return tuple(int(a in axes) for a in range(3))


@cache
def corners(eclass: int, kind: int = -1) -> list[Point]:
    """Corners of a type, in the unit cell."""
    kind = ROOT[eclass] if kind < 0 else kind
    if eclass in (LINE, QUAD, HEX, VERTEX):
        return [tuple(k >> a & 1 for a in range(DIM[eclass])) for k in range(1 << DIM[eclass])]
    if eclass in (TRIANGLE, PRISM):
        flat = [(0, 0), (0, 1) if kind else (1, 0), (1, 1)]
        return flat if eclass == TRIANGLE else [(*p, z) for z in (0, 1) for p in flat]
    if kind in (UP, DOWN):
        base = int(kind == DOWN)
        return [*((x, y, base) for y in (0, 1) for x in (0, 1)), (1 - base,) * 3]
    a, b, _ = _axes(kind)
    return [_unit(), _unit(a), _unit(a, b), _unit(0, 1, 2)]


def shape(eclass: int, kind: int) -> int:
    """Class of an element's own shape."""
    return TET if eclass == PYRAMID and kind < UP else eclass


def faces(eclass: int, kind: int = -1) -> list[list[int]]:
    kind = ROOT[eclass] if kind < 0 else kind
    return FACES_DOWN if eclass == PYRAMID and kind == DOWN else FACES[shape(eclass, kind)]


def kinds(eclass: int) -> range:
    return range({TRIANGLE: 2, PRISM: 2, TET: 6, PYRAMID: 8}.get(eclass, 1))


def inside(eclass: int, kind: int, p: tuple) -> bool:
    """Whether a point of the cell, on no border of types, is in the type."""
    if eclass in (TRIANGLE, PRISM):
        return (p[0] < p[1]) == bool(kind)
    if eclass in (TET, PYRAMID):
        x, y, z = p
        if kind >= UP:
            return (x > z and y > z) if kind == UP else (x < z and y < z)
        a, b, c = _axes(kind)
        return p[a] > p[b] > p[c]
    return True


def in_cell(eclass: int, parent: int) -> list[int]:
    """Types that a cell inside an element of type `parent` may hold."""
    if eclass == PYRAMID:
        return [0, 3, UP, DOWN] if parent >= UP else list(range(UP))
    return list(kinds(eclass))


def centre(points: list[tuple]) -> tuple[Fraction, ...]:
    return tuple(Fraction(sum(p[a] for p in points), len(points)) for a in range(len(points[0])))


@cache
def children(eclass: int, kind: int) -> list[tuple[int, int]]:
    """(cell, type) of each child, in order; the bits of a cell are its coordinates, x lowest."""
    found = []
    for cell in range(1 << DIM[eclass]):
        at = [cell >> a & 1 for a in range(DIM[eclass])]
        for own in in_cell(eclass, kind):
            mid = centre(corners(eclass, own)) if DIM[eclass] else ()
            if inside(eclass, kind, tuple((m + a) / 2 for m, a in zip(mid, at, strict=True))):
                found.append((cell, own))
    return sorted(found)


@cache
def child_index(eclass: int) -> dict[tuple[int, int, int], int]:
    """Number of a child by its parent's type, its cell and its own type."""
    return {(kind, *child): k for kind in kinds(eclass) for k, child in enumerate(children(eclass, kind))}


@cache
def parent_kind(eclass: int) -> dict[tuple[int, int], list[int]]:
    """Types of parents that a child of a (cell, type) may have."""
    out: dict[tuple[int, int], list[int]] = {}
    for kind in kinds(eclass):
        for child in children(eclass, kind):
            out.setdefault(child, []).append(kind)
    return out


def _plane(points: list[Point]) -> tuple[int, ...]:
    """An integer vector at right angles to the face through the points."""
    if len(points[0]) == 1:
        return (1,)
    a = [q - p for p, q in zip(points[0], points[1], strict=True)]
    if len(points[0]) == 2:
        return (a[1], -a[0])
    b = [q - p for p, q in zip(points[0], points[2], strict=True)]
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


@cache
def outward(eclass: int, kind: int, face: int) -> tuple[int, ...]:
    """An integer vector at right angles to a face that points out of the element."""
    all_, own = corners(eclass, kind), faces(eclass, kind)[face]
    n = _plane([all_[c] for c in own])
    away = sum(a * (f - m) for a, f, m in zip(n, centre([all_[c] for c in own]), centre(all_), strict=True))
    return n if away > 0 else tuple(-x for x in n)


@cache
def tree_face(eclass: int, kind: int, face: int) -> int:
    """The only face of the tree that this face of an element can lie on, or -1."""
    n = outward(eclass, kind, face)
    for f in range(len(faces(eclass))):
        if outward(eclass, ROOT[eclass], f) == n:
            return f
    return -1


@cache
def level_of(eclass: int, face: int) -> int:
    """What the face's outward vector makes of its points."""
    n = outward(eclass, ROOT[eclass], face)
    return sum(a * b for a, b in zip(n, corners(eclass)[faces(eclass)[face][0]], strict=True))


@cache
def children_at_face(eclass: int, kind: int, face: int) -> list[tuple[int, int]]:
    """(child, its face) of the children that have a face in a face of their parent."""
    n, at = outward(eclass, kind, face), corners(eclass, kind)[faces(eclass, kind)[face][0]]
    height = 2 * sum(a * b for a, b in zip(n, at, strict=True))
    found = []
    for k, (cell, own) in enumerate(children(eclass, kind)):
        low = [cell >> a & 1 for a in range(DIM[eclass])]
        for f, ids in enumerate(faces(eclass, own)):
            points = [corners(eclass, own)[c] for c in ids]
            if outward(eclass, own, f) == n and all(sum(a * (p + q) for a, p, q in zip(n, x, low, strict=True)) == height for x in points):
                found.append((k, f))
    return found


def turned(n: int, first: int, same: bool, smaller: bool) -> list[int]:
    """Which corner of the other face each corner of a face meets: the lesser face's corner 0 meets corner `first` of the greater; the
    turn is reversed where both faces have the same sense."""
    ring = {1: [0], 2: [0, 1], 3: [0, 1, 2], 4: [0, 1, 3, 2]}[n]
    place = ring.index(first)
    to = [0] * n
    for k, c in enumerate(ring):
        to[c] = ring[(place + (-k if same and n > 2 else k)) % n]
    return to if smaller else [to.index(c) for c in range(n)]


@cache
def crossing(eclass: int, face: int, other: int, other_face: int, orientation: int) -> tuple[tuple[float, ...], ...]:
    """Rows of the affine map from a tree's coordinates into those of the tree across a face; what lies outside one is inside the other."""
    mine, theirs = ([corners(c)[k] for k in faces(c)[f]] for c, f in ((eclass, face), (other, other_face)))
    if len(mine) != len(theirs):
        raise ValueError("the faces differ in shape")
    smaller = RANK[eclass] < RANK[other] or (RANK[eclass] == RANK[other] and face <= other_face)
    to = turned(len(mine), orientation, SENSE[eclass][face] == SENSE[other][other_face], smaller)
    dim = DIM[eclass]
    minus = lambda p, q: [Fraction(a - b) for a, b in zip(p, q, strict=True)]
    n = [Fraction(x) for x in outward(eclass, ROOT[eclass], face)]
    inner = centre(corners(other))
    sides = [n, *(minus(mine[k], mine[0]) for k in range(1, dim))]
    images = [[a - b for a, b in zip(inner, centre(theirs), strict=True)], *(minus(theirs[to[k]], theirs[to[0]]) for k in range(1, dim))]
    inverse = _inverted(sides)
    matrix = [[sum(images[k][r] * inverse[c][k] for k in range(dim)) for c in range(dim)] for r in range(dim)]
    shift = [theirs[to[0]][r] - sum(matrix[r][c] * mine[0][c] for c in range(dim)) for r in range(dim)]
    return tuple(tuple(float(x) for x in [*matrix[r], shift[r]]) for r in range(dim))


def _inverted(rows: list[list[Fraction]]) -> list[list[Fraction]]:
    """The matrix that takes a vector to its shares of the given ones: [coordinate][which]."""
    n = len(rows)
    # Columns of the system are the given vectors; by Gauss and Jordan.
    m = [[rows[k][r] for k in range(n)] + [Fraction(int(r == c)) for c in range(n)] for r in range(n)]
    for k in range(n):
        pivot = next(r for r in range(k, n) if m[r][k])
        m[k], m[pivot] = m[pivot], m[k]
        m[k] = [x / m[k][k] for x in m[k]]
        for r in range(n):
            if r != k and m[r][k]:
                m[r] = [x - m[r][k] * y for x, y in zip(m[r], m[k], strict=True)]
    return [[m[k][n + c] for k in range(n)] for c in range(n)]


#: Every way in which faces of a shape can meet: (class, face, other class, other face, orientation).
def meetings(classes: list[int] | None = None) -> list[tuple[int, int, int, int, int]]:
    use = [c for c in (classes or FACES) if c != VERTEX]
    return [(a, f, b, g, o) for a, b in product(use, use) if DIM[a] == DIM[b] for f, x in enumerate(FACES[a]) for g, y in enumerate(FACES[b]) if len(x) == len(y) for o in range(len(x))]
