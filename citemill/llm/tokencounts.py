"""Operator 1, edit-aware token counts over segment trees.

A text is cut into leaves of about `LEAF` characters at places that no pre-token spans: before a single
space between two characters that aren't white space. A tree over the leaves keeps sums of characters
and tokens. An edit finds its leaves by the character sums, re-encodes them as changed, with further
leaves on either side while a boundary isn't such a place any more, and updates the sums above; all
other leaves keep their counts. The total equals that of encoding the whole changed text. A text without such
a place (one unbroken word, say) is one leaf, which an edit encodes as a whole.

Trees are kept: `token_trees` encodes every text once, into a table of leaves and their counts to be written;
`edited_trees` answers edits from that table alone, encodes touched leaves only, and returns the trees of the
changed texts, to be written in turn. Trees without edits aren't read beyond their key.

The vocabulary is an existing byte-level file, given by its path; nothing is trained. Null texts count
as empty, which has no tokens. A null edit list is an empty one; edits are applied in order, each in
the coordinates of the text that the ones before have left, clipped to it. A null doc_id and repeated
rows are counted like others, row by row. An empty table gives an empty result. Extra columns don't
matter.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm.rows import row_key, small
from citemill.runtime import materialize, table

RANKS_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that the vocabulary was made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 256
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Rows that are answered at once.
ROWS = 500


@functools.cache
def encoder(ranks_file: str) -> Callable[[str], int]:
    """The number of tokens of a text, under a file of byte-pair ranks."""
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def cuts(text: str, leaf: int = LEAF) -> list[int]:
    """Starts of the leaves of a text."""
    starts, at = [0], leaf
    while (m := _CUT.search(text, at)) is not None:
        starts.append(m.start())
        at = m.start() + leaf
    return starts


def _is_cut(left: str, right: str) -> bool:
    return bool(left and len(right) > 1 and right[0] == " " and not left[-1].isspace() and not right[1].isspace())


class TokenTree:
    """Leaves of a text and sums over them; node i has the children 2i and 2i + 1."""

    def __init__(self, text: str, count: Callable[[str], int], leaf: int = LEAF):
        starts = cuts(text, leaf)
        texts = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
        self._grow(texts, [count(t) if t else 0 for t in texts], count)

    @classmethod
    def kept(cls, leaves: list[str], counts: list[int], count: Callable[[str], int]) -> TokenTree:
        """The tree of saved leaves and counts; nothing is encoded."""
        tree = cls.__new__(cls)
        tree._grow(leaves or [""], counts or [0], count)
        return tree

    def _grow(self, texts: list[str], counts: list[int], count: Callable[[str], int]) -> None:
        self.count, self.texts = count, texts
        self.size = 1 << (len(self.texts) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + len(texts)] = list(zip(map(len, texts), counts, strict=True))
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2
        self.encoded = 0

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character number `at` (the last leaf with any, for the end), and its start."""
        if at >= self.chars:
            at = max(0, self.chars - 1)
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at - start >= self.sums[node, 0]:
                start += int(self.sums[node, 0])
                node += 1
        return min(node - self.size, len(self.texts) - 1), start

    def _near(self, leaf: int, step: int) -> int | None:
        """The next leaf with text in a direction."""
        leaf += step
        while 0 <= leaf < len(self.texts) and not self.texts[leaf]:
            leaf += step
        return leaf if 0 <= leaf < len(self.texts) else None

    def _set(self, leaf: int, text: str) -> None:
        self.texts[leaf] = text
        node = self.size + leaf
        self.sums[node] = (len(text), self.count(text) if text else 0)
        self.encoded += len(text)
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, start: int, deleted: int, inserted: str) -> None:
        """Replace `deleted` characters from `start` on by `inserted`."""
        start = min(max(start, 0), self.chars)
        end = min(start + max(deleted, 0), self.chars)
        first, base = self._leaf_at(start)
        last = self._leaf_at(max(start, end - 1))[0]
        body = "".join(self.texts[first : last + 1])
        body = body[: start - base] + inserted + body[end - base :]
        while (before := self._near(first, -1)) is not None and not _is_cut(self.texts[before], body):
            first, body = before, self.texts[before] + body
        while (after := self._near(last, 1)) is not None and not _is_cut(body, self.texts[after]):
            last, body = after, body + self.texts[after]
        for leaf in range(first + 1, last + 1):
            if self.texts[leaf]:
                self._set(leaf, "")
        self._set(first, body)

    def text(self) -> str:
        return "".join(self.texts)

    def leaves(self) -> tuple[list[str], list[int]]:
        """Leaves that hold text, with their counts."""
        counts = self.sums[self.size : self.size + len(self.texts), 1]
        some = [(t, int(n)) for t, n in zip(self.texts, counts, strict=True) if t]
        return [t for t, _ in some], [n for _, n in some]


_TREE = [("leaves", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("n_chars", pa.int64()), ("n_tokens", pa.int64())]
_TREE_SQL = "leaves array<string>, counts array<int>, n_chars long, n_tokens long"


def _columns(trees: list[TokenTree]) -> list[pa.Array]:
    saved = [t.leaves() for t in trees]
    values = [[x for x, _ in saved], [n for _, n in saved], [t.chars for t in trees], [t.tokens for t in trees]]
    return [pa.array(v, kind) for v, (_, kind) in zip(values, _TREE, strict=True)]


def token_trees(docs: DataFrame, ranks_file: str = RANKS_FILE, leaf: int = LEAF) -> DataFrame:
    """doc_id, row (a hash of id and text), leaves, counts, n_chars and n_tokens of every row of `docs`: a table to be kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(ranks_file)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                trees = [TokenTree(text.as_py() or "", count, leaf) for text in some.column(2)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *_columns(trees)], names=["doc_id", "row", *[c for c, _ in _TREE]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text")
    return rows.mapInArrow(run, f"doc_id long, row binary, {_TREE_SQL}")


def edited_trees(trees: DataFrame, ranks_file: str = RANKS_FILE) -> DataFrame:
    """The kept trees of `trees` after their `edits`, an array of (start, deleted, inserted).

    Returns doc_id, row (of the text before), leaves, counts, n_chars and n_tokens as they are now, and before
    (tokens), n_leaves (before) and n_encoded (characters that the edits had encoded again).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(ranks_file)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                made, old = [], []
                for leaves, counts, edits in zip(*(some.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                    tree = TokenTree.kept(leaves, counts, count)
                    old.append((tree.tokens, len(tree.texts)))
                    for e in edits or ():
                        tree.edit(e["start"] or 0, e["deleted"] or 0, e["inserted"] or "")
                    made.append(tree)
                more = [pa.array([b for b, _ in old], pa.int64()), pa.array([n for _, n in old], pa.int64()), pa.array([t.encoded for t in made], pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), *_columns(made), *more], names=["doc_id", "row", *[c for c, _ in _TREE], "before", "n_leaves", "n_encoded"]
                )

    given = trees.select("doc_id", "row", "leaves", "counts", "edits")
    return given.mapInArrow(run, f"doc_id long, row binary, {_TREE_SQL}, before long, n_leaves long, n_encoded long")


def apply_edits(trees: DataFrame, edits: DataFrame, ranks_file: str = RANKS_FILE) -> DataFrame:
    """`edited_trees` for those of the kept `trees` that `edits` (row, edits; one row a tree, in a written table) names."""
    return edited_trees(trees.join(small(edits), "row"), ranks_file)


def sample_edits(n: Column) -> Column:
    """An insertion at a quarter, a deletion at a half and a replacement at three quarters of a text of n characters."""
    edit = lambda start, deleted, inserted: F.struct(
        start.cast("int").alias("start"), F.lit(deleted).alias("deleted"), F.lit(inserted).alias("inserted")
    )
    return F.array(edit(F.floor(n / 4), 0, " (edited) "), edit(F.floor(n / 2), 5, ""), edit(F.floor(n * 3 / 4), 3, "2nd\n\nnew"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents`, before and after three edits each, from kept trees: doc_id, n_tokens, n_leaves, n_edited (tokens
    after the edits), n_chars and n_encoded."""
    trees = materialize(token_trees(table(spark, sf_dir, "documents")), "trees")
    made = edited_trees(trees.withColumn("edits", sample_edits(F.col("n_chars"))))
    return made.select("doc_id", F.col("before").alias("n_tokens"), "n_leaves", F.col("n_tokens").alias("n_edited"), "n_chars", "n_encoded")
