"""Edit-aware token counts.

Each document keeps a segment tree over its pre-tokens (runs of bytes without
white space, which tokens of the tokenizer never cross): leaves hold token
counts, inner nodes the sums below. An edit touches the pre-tokens that it
overlaps and, as it may join or split words, those next to it; only that region
is re-encoded, and the sums on its way to the root are updated. The count after
all edits is the root.

Edits come as a table or, for a whole corpus, from a rule on each text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagest.llm.common import chunks, doc_key, utf8, word_spans
from almagest.llm.packing import WordIds, word_ids

#: Personal data that the registered query's edits mask.
MASKS = (
    (regex.compile(rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), b"<email>"),
    (regex.compile(rb"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])"), b"<ip>"),
    (regex.compile(rb"(?<![0-9A-Za-z])\+?[0-9][0-9 ()-]{7,16}[0-9](?![0-9A-Za-z])"), b"<phone>"),
)

Edit = tuple[int, int, bytes]


class TokenTree:
    """Token counts of a text (UTF-8) under edits."""

    def __init__(self, text: bytes, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, encoder: WordIds):
        self.text, self.starts, self.ends, self.encoder = text, starts, ends, encoder
        # leaf 0 is what edits put before the first pre-token
        self.leaves = 1 << len(counts).bit_length()
        level = np.zeros(self.leaves, np.int64)
        level[1:len(counts) + 1] = counts
        levels = [level]
        while len(level) > 1:
            level = level[0::2] + level[1::2]
            levels.append(level)
        self.sums = np.concatenate([np.zeros(1, np.int64), *levels[::-1]])  # node 1 is the root

    @property
    def total(self) -> int:
        return int(self.sums[1])

    def _put(self, leaf: int, count: int) -> None:
        node, change = leaf + self.leaves, count - int(self.sums[leaf + self.leaves])
        while node and change:
            self.sums[node] += change
            node >>= 1

    def edit(self, edits: list[Edit]) -> tuple[bytes, int]:
        """Apply edits (byte ranges of the text and what replaces them).
        Returns the new text and how many pre-tokens were encoded anew.
        Ranges are clipped to the text; of overlapping ones the first counts."""
        edits = _in_order(edits, len(self.text))
        pieces, done, encoded, i = [], 0, 0, 0
        while i < len(edits):
            # pre-tokens that the edit touches or borders on
            first = int(np.searchsorted(self.ends, edits[i][0], "left"))
            last = int(np.searchsorted(self.starts, edits[i][1], "right")) - 1
            j = i + 1
            while j < len(edits) and (edits[j][0] == edits[j - 1][1]
                                      or int(np.searchsorted(self.ends, edits[j][0], "left")) <= last):
                last = max(last, int(np.searchsorted(self.starts, edits[j][1], "right")) - 1)
                j += 1
            begin = min(edits[i][0], int(self.starts[first])) if first <= last else edits[i][0]
            end = max(edits[j - 1][1], int(self.ends[last])) if first <= last else edits[j - 1][1]
            region, at = [], begin
            for s, e, new in edits[i:j]:
                region += [self.text[at:s], new]
                at = e
            region = b"".join([*region, self.text[at:end]])
            words = [w.decode("utf-8", "replace") for w in region.split()]
            count = self.encoder.counts(words)
            encoded += len(words)
            if first > last:  # between pre-tokens: counted with the one before
                self._put(last + 1, count + int(self.sums[last + 1 + self.leaves]))
            else:
                self._put(first + 1, count)
                for leaf in range(first + 2, last + 2):
                    self._put(leaf, 0)
            pieces += [self.text[done:begin], region]
            done = end
            i = j
        return b"".join([*pieces, self.text[done:]]), encoded


def _in_order(edits: list[Edit], size: int) -> list[Edit]:
    out: list[Edit] = []
    for s, e, new in sorted(edits, key=lambda x: (x[0], x[1])):
        s = min(max(0, s), size)
        e = min(max(s, e), size)
        if not out or s >= out[-1][1]:  # insertions at one place all count, in given order
            out.append((s, e, new))
    return out


def masking(text: bytes) -> list[Edit]:
    """Edits that mask personal data."""
    return [(m.start(), m.end(), new) for pattern, new in MASKS for m in pattern.finditer(text)]


def _counted(path: str, rule: Callable[[bytes], list[Edit]] | None):
    def run(batches):
        encoder = word_ids(path, None)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            data, off = utf8(texts)
            given = None if rule else batch.column("edits").to_pylist()
            for i, j in chunks(off, 1 << 21):
                part, base = data[off[i]:off[j]], off[i:j + 1] - off[i]
                raw = part.tobytes()
                starts, ends, rows = word_spans(part, base)
                code, _ = encoder.lookup(texts.slice(i, j - i), parted=False)
                counts = encoder.size[code]
                total = np.bincount(rows, weights=counts, minlength=j - i).astype(np.int64)
                at = np.searchsorted(rows, np.arange(j - i + 1))
                after, made, anew = total.copy(), np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                for r in range(j - i):
                    text = raw[base[r]:base[r + 1]]
                    edits = rule(text) if rule else [(x["start"], x["end"], (x["text"] or "").encode()) for x in given[i + r] or []]
                    if edits:
                        a, b = at[r], at[r + 1]
                        tree = TokenTree(text, starts[a:b] - base[r], ends[a:b] - base[r], counts[a:b], encoder)
                        _, anew[r] = tree.edit(edits)
                        after[r], made[r] = tree.total, len(_in_order(edits, len(text)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(at)), pa.array(total), pa.array(made),
                     pa.array(anew), pa.array(after)],
                    names=["doc_id", "n_pretokens", "n_tokens", "n_edits", "n_reencoded", "n_tokens_after"])
    return run


_SCHEMA = "doc_id long, n_pretokens long, n_tokens long, n_edits long, n_reencoded long, n_tokens_after long"


def count_ruled(docs: DataFrame, tokenizer: str, rule: Callable[[bytes], list[Edit]] = masking) -> DataFrame:
    """Token counts of every row before and after the edits that rule makes:
    doc_id, n_pretokens, n_tokens, n_edits, n_reencoded (pre-tokens encoded for
    the edits), n_tokens_after. tokenizer: path of a tokenizer that drops white
    space. Null text is empty; an empty table gives an empty result."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counted(tokenizer, rule), _SCHEMA)


def count_edited(docs: DataFrame, edits: DataFrame, tokenizer: str) -> DataFrame:
    """As :func:`count_ruled`, for edits given as rows (doc_id, start, end,
    text): byte ranges of the document's text and what replaces them. Rows that
    repeat a doc_id all get its edits; edits of unknown documents, or with a
    null start or end, do nothing."""
    per = (edits.filter("start IS NOT NULL AND end IS NOT NULL").groupBy(doc_key().alias("__k1"))
           .agg(F.sort_array(F.collect_list(F.struct(
               F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
               F.col("text").cast("string").alias("text")))).alias("edits")))
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        doc_key().alias("__k1")).join(per, "__k1", "left").select("doc_id", "text", "edits"))
    return rows.mapInArrow(_counted(tokenizer, None), _SCHEMA)
