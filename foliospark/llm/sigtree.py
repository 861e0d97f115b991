"""Signature trees: OR-combined token bitmaps and size ranges, and their dual traversal."""

from __future__ import annotations

import numpy as np

#: Children of a node. Two, since the OR of more sets that have little in common has too many bits
#: to bound anything.
FAN = 2
#: Sizes of a tree's members are put together in steps of this ratio.
RATIO = 1.15
#: Words of bitmaps that are bounded at once, a node pair at least.
STEP = 1 << 20


def width_of(n: int) -> int:
    """Bits of the bitmap of a set of ``n`` tokens: a power of two from 4 n to 8 n, 64 at least."""
    return max(64, 1 << (4 * n - 1).bit_length())


def bitmap(tokens: np.ndarray, width: int) -> np.ndarray:
    """The tokens' places modulo ``width``, in 64-bit words."""
    at = (tokens & np.uint64(width - 1)).astype(np.int64)
    bits = np.zeros(width, np.uint8)
    bits[at] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray) -> np.ndarray:
    """The bitmap at half its width: places are modulo a power of two."""
    half = bits.shape[-1] // 2
    return bits[..., :half] | bits[..., half:]


def need(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least overlap of sets of sizes ``a`` and ``b`` whose Jaccard similarity is 0.75."""
    return -(-3 * (a + b) // 7)


class Tree:
    """Nodes over members in the order given, level by level: leaves are single members.

    A node has the OR of its members' bitmaps, their smallest and largest size, the most tokens
    that share a bit with another one of their set, and their class if they have one class.
    """

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, classes: np.ndarray):
        spare = sizes - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, spare, classes)]
        while len(self.levels[-1][1]) > 1:
            b, lo, hi, sp, cl = self.levels[-1]
            at = np.arange(0, len(lo), FAN)
            low, high = np.minimum.reduceat(cl, at), np.maximum.reduceat(cl, at)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(sp, at), np.where(low == high, low, -1)))


def _survivors(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node pairs that may hold a link: not all of one class, sizes near enough, and overlap at
    most the common bits and the tokens without a bit of their own."""
    keep = ~((a[4][i] == b[4][j]) & (a[4][i] >= 0)) & (4 * a[2][i] >= 3 * b[1][j]) & (4 * b[2][j] >= 3 * a[1][i])
    i, j = i[keep], j[keep]
    out = []
    step = max(1, STEP // a[0].shape[1])
    for s in range(0, len(i), step):
        x, y = i[s : s + step], j[s : s + step]
        common = np.bitwise_count(a[0][x] & b[0][y]).sum(1, dtype=np.int64)
        most = common + np.minimum(a[3][x], b[3][y])
        out.append(most >= need(a[1][x], b[1][y]))
    keep = np.concatenate(out) if out else np.empty(0, bool)
    return i[keep], j[keep]


def dual(a: Tree, b: Tree | None = None, log: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Member pairs (of ``a`` with ``b``, or of ``a`` with itself, i < j) that may link. ``log``
    takes (levels of both nodes, node pairs tried, pairs left) of each step."""
    same = b is None
    b = a if same else b
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(i):
        tried = len(i)
        i, j = _survivors(a.levels[la], b.levels[lb], i, j)
        if log is not None:
            log.append((la, lb, tried, len(i)))
        if la == lb == 0:
            break
        if la >= lb:
            la -= 1
            i, j = _children(i, j, len(a.levels[la][1]))
        if lb > la or same and lb > 0:
            lb -= 1
            j, i = _children(j, i, len(b.levels[lb][1]))
        if same:
            keep = i <= j
            i, j = i[keep], j[keep]
    keep = i < j if same else np.ones(len(i), bool)
    return i[keep], j[keep]


def _children(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    kids = (i[:, None] * FAN + np.arange(FAN)).ravel()
    other = np.repeat(j, FAN)
    keep = kids < n
    return kids[keep], other[keep]


def leaf_order(bits: np.ndarray, sizes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """An order that puts alike members next to each other: those of one class, then by size in
    steps of RATIO, then by the first and last bit set. The first bit is the least token modulo
    the width, which alike sets share with a chance of their similarity, as in min-hashing."""
    times = np.bincount(classes - classes.min())[classes - classes.min()]
    step = (np.log(np.maximum(sizes, 1)) / np.log(RATIO)).astype(np.int64)
    rows, used = np.arange(len(bits)), bits != 0
    first, last = used.argmax(1), bits.shape[1] - 1 - used[:, ::-1].argmax(1)
    low, high = bits[rows, first], bits[rows, last]
    least = first * 64 + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1))
    most = last * 64 + np.floor(np.log2(np.maximum(high, 1).astype(np.float64))).astype(np.int64)
    return np.lexsort((most, least, step, np.where(times > 1, classes, -1)))


def candidates(bits: list[np.ndarray], sizes: np.ndarray, classes: np.ndarray, side: np.ndarray | None = None, log: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that may link, of different classes. With ``side``, pairs have one place on
    each side (False, True).

    Members of one bitmap width form a tree; sets that may link differ by one width at most, and
    the wider one is folded.
    """
    words = np.array([len(b) for b in bits])
    found = []
    sides = [np.ones(len(bits), bool)] if side is None else [~side, side]

    def ordered(at: np.ndarray) -> np.ndarray:
        return at[leaf_order(np.stack([bits[k] for k in at]), sizes[at], classes[at])]

    groups = [{int(w): ordered(np.flatnonzero((words == w) & s)) for w in np.unique(words[s])} for s in sides]
    tree = lambda at, half: Tree(np.stack([fold(bits[k]) if half else bits[k] for k in at]), sizes[at], classes[at])
    for x, g in enumerate(groups):
        for w, at in g.items():
            own = tree(at, False)
            if side is None:
                i, j = dual(own, log=log)
                found.append((at[i], at[j]))
            elif x == 0 and w in groups[1]:
                i, j = dual(own, tree(groups[1][w], False), log)
                found.append((at[i], groups[1][w][j]))
            other = groups[-1 - x] if side is not None else g
            if 2 * w in other:
                i, j = dual(own, tree(other[2 * w], True), log)
                found.append((at[i], other[2 * w][j]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
