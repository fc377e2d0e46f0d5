"""Deep-shallow sorting of strings of one length that lie in a shared text.

Multikey quicksort to a shallow depth, eight bytes a key, for all groups at once; what still agrees has a long common
prefix and goes to blind tries, which look at one byte per branching and compare whole strings once at a leaf.
"""

from __future__ import annotations

import numpy as np

SHALLOW_BYTES = 32


class BlindTrie:
    """Compacted trie over strings text[at : at + length] that keeps branching depths and bytes only.

    A leaf is [first string's position, [members]]; a node is (depth, {byte: child}).
    """

    def __init__(self, text: bytes, length: int, depth: int):
        self.text, self.length, self.depth = text, length, depth
        self.root: list | tuple | None = None
        self.leaves: list[list] = []

    def insert(self, at: int, member: int) -> None:
        text, n = self.text, self.length
        if self.root is None:
            self.root = self._leaf(at, member)
            return
        node = self.root
        while isinstance(node, tuple):  # blind: only branching bytes are looked at
            depth, children = node
            node = children.get(text[at + depth]) or next(iter(children.values()))
        mine, other = text[at : at + n], text[node[0] : node[0] + n]
        if mine == other:
            node[1].append(member)
            return
        low, high = self.depth, n  # where they first differ
        while high - low > 1:
            mid = (low + high) // 2
            if mine[low:mid] == other[low:mid]:
                low = mid
            else:
                high = mid
        differ = low
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < differ:
            parent = node
            node = node[1][mine[node[0]]]
        if isinstance(node, tuple) and node[0] == differ:
            node[1][mine[differ]] = self._leaf(at, member)
            return
        new = (differ, {other[differ]: node, mine[differ]: self._leaf(at, member)})
        if parent is None:
            self.root = new
        else:
            parent[1][mine[parent[0]]] = new

    def _leaf(self, at: int, member: int) -> list:
        leaf = [at, [member]]
        self.leaves.append(leaf)
        return leaf

    def in_order(self) -> list[list[int]]:
        """Members of equal strings, in the order of the strings."""
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out.append(node[1])
        return out


def word_at(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position on, as a big-endian number."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | text[at + k]
    return out


def equal_classes(text: bytes, at: np.ndarray, group: np.ndarray, length: int, shallow: int = SHALLOW_BYTES) -> np.ndarray:
    """A class number for each string text[at : at + length]: equal for equal strings of one group, and only for them.

    Numbers follow (group, string) order wherever a class has company; strings alone in their prefix stop early.
    """
    data = np.frombuffer(text + bytes(8), np.uint8)
    label = np.unique(group, return_inverse=True)[1].astype(np.int64)
    live = np.arange(len(at))
    for depth in range(0, min(shallow, length), 8):
        size = np.bincount(label[live], minlength=len(at))
        live = live[size[label[live]] > 1]
        if not len(live):
            return label
        word = word_at(data, at[live] + depth)
        if depth + 8 > length:
            word >>= np.uint64(8 * (depth + 8 - length))
        order = np.lexsort((word, label[live]))
        live, word = live[order], word[order]
        old = label[live]
        new = np.r_[True, (old[1:] != old[:-1]) | (word[1:] != word[:-1])]
        # a label is the place of the first of its class among all that are live, above every label given before
        label[live] = np.maximum.accumulate(np.where(new, np.arange(len(live)), 0)) + (label.max() + 1)
    if length <= shallow:
        return label
    size = np.bincount(label[live], minlength=int(label.max()) + 1)
    live = live[size[label[live]] > 1]
    live = live[np.argsort(label[live], kind="stable")]
    if not len(live):
        return label
    first = np.flatnonzero(np.r_[True, label[live][1:] != label[live][:-1]])
    last = np.r_[first[1:], len(live)]
    top = int(label.max()) + 1
    two = last - first == 2
    # a trie of two strings has one branching: compare them directly, many at a time
    for c in range(0, int(two.sum()), 4096):
        a, b = live[first[two][c : c + 4096]], live[first[two][c : c + 4096] + 1]
        span = np.arange(shallow, length)
        apart = (data[at[a][:, None] + span] != data[at[b][:, None] + span]).any(1)
        label[b[apart]] = top + np.arange(int(apart.sum()))
        top += int(apart.sum())
    for i, j in zip(first[~two].tolist(), last[~two].tolist(), strict=True):
        members = live[i:j].tolist()
        trie = BlindTrie(text, length, shallow)
        for m in members:
            trie.insert(int(at[m]), m)
        for same in trie.in_order():
            label[same] = top
            top += 1
    return label
