"""Alignment of two tokenizers' tokens over the same bytes, by divide and conquer at shared cuts.

A cut is a byte offset at which a token of either encoding ends. An interval is divided at a
shared cut near its middle: ends of the first encoding are looked up among those of the second by
bisection, from the middle outwards. Both parts are treated alike, all intervals of a level
together, until an interval has no shared cut inside: it is one group.

Documents are worked on in pages of about ``PAGE_BYTES`` of text. A page keeps its distinct pairs
of linked ids, how often each occurs, and its links as places in that list. Only distinct pairs of
pages are counted over the corpus and joined back, so a pair that occurs everywhere costs a row a
page; the counts of a page are then gathered in one row, which meets its documents' links.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import fresh, kept_fields, stored
from tidemark.llm.token_counts import SPLIT, _byte_letters

#: Text of a page, which bounds what a task holds beside its longest text.
PAGE_BYTES = 1_000_000
#: Steps from the middle that are tried for all intervals at once before the whole interval is.
NEAR = 4


def shared_cuts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in ``a`` of the ends that ``b`` has too, the last one included.

    Both ascend strictly and end alike.
    """

    def shared(places: np.ndarray) -> np.ndarray:
        return b[np.searchsorted(b, a[places])] == a[places]

    found = [np.array([len(a) - 1])] if len(a) else []
    low, high = np.array([0]), np.array([len(a) - 1])
    while True:
        some = low < high
        low, high = low[some], high[some]
        if not len(low):
            return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        middle = (low + high) // 2
        cut = np.full(len(low), -1)
        for step in sorted(range(1 - NEAR, NEAR), key=abs):
            at = middle + step
            open_ = np.flatnonzero((cut < 0) & (at >= low) & (at < high))
            hit = open_[shared(at[open_])]
            cut[hit] = at[hit]
        # intervals without one near the middle: the nearest of all their ends
        far = np.flatnonzero((cut < 0) & (high - low > NEAR))
        if len(far):
            width = high[far] - low[far]
            begin = np.cumsum(width) - width
            at = np.arange(width.sum()) + np.repeat(low[far] - begin, width)
            distance = np.where(shared(at), np.abs(at - np.repeat(middle[far], width)), len(a))
            nearest = np.minimum.reduceat(distance, begin)
            first = np.flatnonzero(distance == np.repeat(nearest, width))
            owner = np.searchsorted(begin, first, "right") - 1
            chosen = at[first[np.unique(owner, return_index=True)[1]]]
            cut[far] = np.where(nearest < len(a), chosen, -1)
        divided = cut >= 0
        found.append(cut[divided])
        low, high = (
            np.concatenate([low[divided], cut[divided] + 1]),
            np.concatenate([cut[divided], high[divided]]),
        )


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens.

    The byte-level vocabulary's ids are the ranks of its merges, which is checked; so the ranks are
    all that an encoder needs, and special tokens' strings are plain text to it.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in t): k for t, k in model["vocab"].items() if all(c in letters for c in t)}
        merges = ("".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"])
        made = [model["vocab"][m] for m in merges]
        if made != sorted(made) or len(made) + 256 != len(ranks):
            raise ValueError("ids of the byte-level vocabulary have to follow its merges")
        self.a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            self.bytes_a[k] = token
        self.bytes_b = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()
            for k, piece in ((k, self.b.id_to_piece(k)) for k in range(self.b.get_piece_size()))
        ]
        self.size_a, self.size_b = (np.array([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        #: Ids as text with what may stand before them, first those of ``a``, then those of ``b``.
        self.spelled = [sep + str(k) for sep in ("", ",", ";") for k in range(len(self.bytes_a))]
        self.spelled += [sep + str(k) for sep in (",", "|") for k in range(len(self.bytes_b))]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both encodings; none where the bytes of either are not those of the text behind a space."""
        none = np.zeros(0, np.int64)
        bytes_b, out = self.bytes_b, []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            raw = b" " + text.encode()
            a = self.a.encode_to_numpy(" " + text, disallowed_special=())
            same = text and b"".join([bytes_b[k] for k in b]) == raw and self.a.decode_bytes(a.tolist()) == raw
            out.append((a, np.array(b, np.int64)) if same else (none, none))
        return out


@functools.cache
def loaded(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def align_page(texts: list[str], tok: Tokenizers) -> dict:
    """Groups and links of all texts of a page. Texts are laid end to end: where one ends is a shared cut."""
    pairs = tok.encode(texts)
    n_a, n_b = (np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1))
    ids_a, ids_b = (np.concatenate([p[k] for p in pairs] or [np.zeros(0)]).astype(np.int64) for k in (0, 1))
    ends_a, ends_b = np.cumsum(tok.size_a[ids_a]), np.cumsum(tok.size_b[ids_b])
    cuts_a = shared_cuts(ends_a, ends_b)
    cuts_b = np.searchsorted(ends_b, ends_a[cuts_a])
    from_a, from_b = np.cumsum(n_a), np.cumsum(n_b)
    n_groups = np.diff(np.searchsorted(cuts_a, from_a), prepend=0)

    # every stretch between two ends of any kind is the overlap of one pair
    n_bytes = int(ends_a[-1]) + 1 if len(ends_a) else 0
    is_a, is_b = (np.bincount(ends, minlength=n_bytes) for ends in (ends_a, ends_b))
    stretches = np.flatnonzero(is_a | is_b)
    code = (ids_a[(np.cumsum(is_a) - is_a)[stretches]] * len(tok.bytes_b) + ids_b[(np.cumsum(is_b) - is_b)[stretches]])
    n_links = n_a + n_b - n_groups
    met, codes = pd.factorize(code)
    ascending = np.argsort(codes)
    place = np.empty(len(codes), np.int64)
    place[ascending] = np.arange(len(codes))
    codes, links = codes[ascending], place[met]
    times = np.bincount(links, minlength=len(codes))

    # groups as text: the tokens of both kinds in the order of groups, each with what stands before it
    before_a, before_b = (np.concatenate([[0], cuts + 1])[:-1] for cuts in (cuts_a, cuts_b))  # tokens before each group
    first_a, first_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    first_a[before_a], first_b[before_b] = True, True
    group_a, group_b = np.cumsum(first_a) - 1, np.cumsum(first_b) - 1
    separator = np.where(first_a, 2, 1)
    separator[(from_a - n_a)[n_a > 0]] = 0
    size_a, size_b = len(tok.bytes_a), len(tok.bytes_b)
    where_a = np.arange(len(ids_a)) + before_b[group_a]
    where_b = np.arange(len(ids_b)) + cuts_a[group_b] + 1
    index = np.empty(len(ids_a) + len(ids_b), np.int64)
    index[where_a] = ids_a + separator * size_a
    index[where_b] = 3 * size_a + ids_b + first_b * size_b
    flat, groups, at = index.tolist(), [], 0
    for n in (n_a + n_b).tolist():
        groups.append("".join([tok.spelled[k] for k in flat[at : at + n]]))
        at += n
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": groups, "links": links, "codes": codes, "times": times}


def _pages(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts make up a page; a longer text is one by itself."""
    begin, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= PAGE_BYTES:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def align(docs: DataFrame, path_a: str, path_b: str, groups: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_a n_b n_groups n_links n_best count_sum`` and ``groups``.

    ``path_a`` is a byte-level vocabulary file, ``path_b`` a sentence-piece model; the first is
    given a space before each text, which the second adds itself. Special tokens' strings within
    texts are plain text. A link is a pair of tokens whose bytes overlap; its count is the number
    of links of the corpus between the same two ids. ``n_best`` counts links whose count is the
    highest of their second id, ties included; ``count_sum`` adds counts up. ``groups`` lists ids,
    ``a1,a2|b1;a3|b2``, or is the SHA-256 of that if ``groups="sha256"``, and empty without tokens.

    Null and empty texts, and those that the tokens of either side do not spell byte by byte (some
    models change characters), have no tokens: zeros. Rows keep their columns, repeated ones are
    counted each; clashing names get ``_`` appended. A very long text is a page by itself, whose
    task holds some hundred bytes for each of its tokens. The empty table gives the empty table.
    """
    if groups not in ("text", "sha256"):
        raise ValueError("groups must be 'text' or 'sha256'")
    kept = kept_fields(docs, keep_text)
    numbers = fresh(docs, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    long, text = T.LongType(), T.StringType()
    schema = T.StructType(
        [T.StructField(f"k{i}", f.dataType) for i, f in enumerate(kept)]
        + [T.StructField(n, long) for n in ("n_a", "n_b", "n_groups", "n_links")]
        + [T.StructField("groups", text), T.StructField("links", T.ArrayType(T.IntegerType())), T.StructField("page", long)]
        + [T.StructField(n, T.ArrayType(long)) for n in ("codes", "times")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(path_a, path_b)
        page = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for begin, end in _pages(texts):
                found, n = align_page(texts[begin:end], tok), end - begin
                spelled = found["groups"] if groups == "text" else [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found["groups"]]
                offsets = np.fromiter(accumulate(found["n_links"].tolist(), initial=0), np.int32, n + 1)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(f.name).slice(begin, n) for f in kept),
                    *(pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                    pa.array(spelled, pa.string()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(found["links"].astype(np.int32))),
                    pa.array(np.full(n, page)),
                    *(_on_first(found[c], n) for c in ("codes", "times"))],
                    names=schema.names)
                page += 1

    rows = stored(docs.mapInArrow(run, schema), "aligned")
    priced = _with_prices(rows, _size_b(path_b))
    return priced.select(
        *(F.col(f"k{i}").alias(f.name) for i, f in enumerate(kept)),
        *(F.col(n).alias(new) for n, new in zip(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"), numbers)))


def _on_first(values: np.ndarray, n: int) -> pa.Array:
    """A list column whose first row has all values; the other rows are empty."""
    return pa.ListArray.from_arrays(pa.array([0] + n * [len(values)], pa.int32()), pa.array(values, pa.int64()))


def _size_b(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


def _with_prices(rows: DataFrame, size_b: int) -> DataFrame:
    """Documents with ``n_best`` and ``count_sum``, by the counts that their page's pairs have in the corpus.

    The highest count of each second id is one row an id of that vocabulary, whose size bounds what is broadcast.
    """
    listed = rows.where(F.size("codes") > 0).select("page", F.inline(F.arrays_zip("codes", "times"))).withColumnsRenamed({"codes": "code", "times": "n"})
    counts = listed.groupBy("code").agg(F.sum("n").alias("total"))
    counts = stored(counts.withColumn("b", (F.col("code") % size_b).cast("int")), "pair-counts")
    highest = counts.groupBy("b").agg(F.max("total").alias("highest"))
    priced = counts.join(F.broadcast(highest), "b").select("code", "total", (F.col("total") == F.col("highest")).alias("best"))
    of_page = (
        listed.select("page", "code").join(priced, "code")
        .groupBy("page").agg(F.sort_array(F.collect_list(F.struct("code", "total", "best"))).alias("prices"))
        .select("page", F.col("prices.total").alias("totals"), F.col("prices.best").alias("best")))
    return rows.drop("codes", "times").join(of_page, "page", "left").withColumns({
        "n_best": F.size(F.filter("links", lambda k: F.get(F.col("best"), k))).cast("long"),
        "count_sum": F.aggregate("links", F.lit(0).cast("long"), lambda s, k: s + F.get(F.col("totals"), k))})
