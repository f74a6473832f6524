"""Exact token counts of every prefix of a text, by dynamic programming over byte-pair merges.

Within a piece of pre-tokenized text, the encoding of each prefix is the encoding of a shorter
prefix and one last token. Exactly one last token agrees with the merges: the one whose pair
with the shorter prefix's last token encodes to itself. So one pass fills a table of counts,
and the counts of pieces add up. A stored table answers how many tokens a prefix has, and
which is the longest prefix within a budget, without encoding again.

Pieces recur, so each worker keeps the tables of the pieces it has seen, up to ``CACHE`` of them.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.shared import fresh, kept_fields

#: White space as Unicode has it, and the split pattern of this family of byte-level
#: vocabularies (fixed values).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"""
#: Runs that the split pattern never joins: a word with the one space before it, or white space.
RUNS = rf"""(?: ?[^{SPACE}]+)|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]"""
CACHE = 500_000
LONG_PIECE = 64


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in printable)
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Counts for one vocabulary file of the byte-level kind."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.tokens = {to_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.tokens.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        n = max(self.bytes_of) + 1
        self.made, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (self.tokens[to_bytes(x)] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            token = self.tokens[self.bytes_of[a] + self.bytes_of[b]]
            self.merges[a, b] = (rank, token)
            if self.made[token] < 0:
                self.made[token], self.left[token], self.right[token] = rank, a, b
        self.rank = {pair: rank for pair, (rank, _) in self.merges.items()}
        self.whole = {b: t for b, t in self.tokens.items() if self.merged(b) == [t]}
        self.longest = max(map(len, self.tokens))
        special = [t["content"] for t in spec.get("added_tokens", ())]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(SPLIT)
        self.runs = re.compile(RUNS)
        self.space = re.compile(f"[{SPACE}]+")
        self.allowed: dict[tuple[int, int], bool] = {}
        self.counts: dict[str, int] = {}
        self.tables: dict[str, np.ndarray] = {}

    def merged(self, data: bytes) -> list[int]:
        """The encoding of a short piece by applying merges, lowest rank first."""
        ids = [self.tokens[data[k : k + 1]] for k in range(len(data))]
        while len(ids) > 1:
            best = min(((*self.merges[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merges), default=None)
            if best is None:
                break
            _, token, k = best
            ids[k : k + 2] = [token]
        return ids

    def fits(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b`` together encode to just these two tokens.

        Merges are taken back from the latest on, at both sides of the border. If at some time
        the two tokens at the border could have merged before the merge taken back, they would
        have. Equal merges go from left to right, which decides ties.
        """
        rank, made, before = self.rank, self.made, len(self.rank)
        while True:
            if rank.get((a, b), before) < before:
                return False
            x, y = made[a], made[b]
            if x > y:
                before, a = x, self.right[a]
            elif y < 0:
                return True
            else:
                before, b = y + 1, self.left[b]

    def byte_counts(self, data: bytes) -> list[int]:
        """Token counts of all byte prefixes of one piece, the empty one included."""
        whole, allowed, fits, longest = self.whole, self.allowed, self.fits, self.longest
        last, counts = [-1], [0]
        for end in range(1, len(data) + 1):
            token = whole.get(data[:end]) if end <= longest else None
            if token is not None:
                last.append(token)
                counts.append(1)
                continue
            for begin in range(max(1, end - longest), end):
                token = whole.get(data[begin:end])
                if token is None:
                    continue
                key = (last[begin], token)
                good = allowed.get(key)
                if good is None:
                    if len(allowed) >= 2 * CACHE:
                        allowed.clear()
                    good = allowed[key] = fits(*key)
                if good:
                    last.append(token)
                    counts.append(counts[begin] + 1)
                    break
            else:
                raise ValueError("the vocabulary has no token for a byte")
        return counts

    def table(self, piece: str) -> np.ndarray:
        """Token counts of all prefixes of a piece, by code points."""
        found = self.tables.get(piece)
        if found is None:
            data = piece.encode("utf-8", "surrogatepass")
            counts = np.array(self.byte_counts(data), np.int32)
            starts = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
            found = counts[np.append(np.flatnonzero(starts), len(data))]
            if len(piece) <= LONG_PIECE:
                if len(self.tables) >= CACHE // 4:
                    self.tables.clear()
                self.tables[piece] = found
        return found

    def count_run(self, run: str) -> int:
        """Tokens of a run, which may be several pieces."""
        found = self.counts.get(run)
        if found is None:
            found = sum(self.byte_counts(piece.encode("utf-8", "surrogatepass"))[-1] for piece in self.split.findall(run))
            if len(run) <= LONG_PIECE:
                if len(self.counts) >= CACHE:
                    self.counts.clear()
                self.counts[run] = found
        return found

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between special strings, and those."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def count(self, text: str) -> int:
        """Tokens of the whole text: the last entry of :meth:`prefixes`."""
        known, total = self.counts, 0
        for segment, is_special in self.segments(text):
            if is_special:
                total += 1
                continue
            for run in self.runs.findall(segment):
                n = known.get(run)
                total += self.count_run(run) if n is None else n
        return total

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of all ``len(text) + 1`` prefixes, each as if the text ended there.

        Where a text ends changes how it is split in two cases: white space before a word is
        one piece while nothing follows, and an unfinished contraction or special string is
        ordinary text.
        """
        out, total = [np.zeros(1, np.int32)], 0
        before = ""
        for segment, is_special in self.segments(text):
            if is_special:
                ends = [self.count(before + segment[:k]) - self.count(before) for k in range(1, len(segment))]
                out.append(total + np.array([*ends, 1], np.int32))
                total, before = total + 1, ""
                continue
            run, run_total = "", 0  # the white space that ends the prefix, and the tokens before it
            for piece in self.split.findall(segment):
                table = self.table(piece)
                counts = total + table[1:]
                if piece in ("'re", "'ve", "'ll"):  # their first letter alone is a piece
                    counts[1] = total + self.count_run("'") + self.count_run(piece[1])
                if run and self.space.match(piece):
                    counts[0] = run_total + int(self.table(run + piece[0])[-1])
                out.append(counts)
                if self.space.fullmatch(piece):
                    run, run_total = (run + piece, run_total) if run else (piece, total)
                else:
                    run = ""
                total += int(table[-1])
            before = segment
        return np.concatenate(out)

    def cut(self, text: str, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens."""
        return int(np.flatnonzero(self.prefixes(text) <= budget)[-1])


@functools.cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, path: str, budget: int | None = None, keep_prefixes: bool = False, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens``; ``cut`` for a budget; ``prefix_tokens`` if asked for.

    ``path`` is the vocabulary file, the same on every executor. ``cut`` is the length in code
    points of the longest prefix within the budget. ``prefix_tokens`` has an entry per prefix,
    the empty one first, so that any later budget is answered from the table. A null text
    counts as empty: 0 bytes, 0 tokens. Rows are independent and keep all their columns.
    """
    names = fresh(docs, "n_bytes", "n_tokens", "cut", "prefix_tokens")
    types = [T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.IntegerType())]
    wanted = [True, True, budget is not None, keep_prefixes]
    kept = kept_fields(docs, keep_text)
    schema = T.StructType(kept + [T.StructField(n, t) for n, t, w in zip(names, types, wanted, strict=True) if w])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n_tokens = [table.count(t) for t in texts]
            columns = [pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n_tokens, pa.int64())]
            if budget is not None:
                columns.append(pa.array([table.cut(t, budget) if n > budget else len(t) for t, n in zip(texts, n_tokens, strict=True)], pa.int64()))
            if keep_prefixes:
                columns.append(pa.array([table.prefixes(t) for t in texts], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], names=schema.names)

    return docs.mapInArrow(run, schema)
