"""BPE encoding and decoding that reuses the encodings of content-defined chunks.

A normalised text is cut where a rolling hash of the last ``WINDOW`` bytes has a given form, so
that equal passages are cut alike wherever they stand. Chunks are encoded on their own, each
once: those that documents share are counted over the whole corpus, and a bounded table of the
most profitable ones is encoded in one job and sent to all tasks (``shared_chunks``); a worker
keeps the others that it meets, up to ``KEPT``. Neither bound changes a result.

A cut may fall into a word. So each join of two chunks is repaired: the text is encoded again
from the last piece that the left chunk alone determines, until a piece begins where a piece of
the right chunk begins. From there on both segmentations are the same, and the right chunk's
tokens stand. If no piece agrees before that chunk ends, the next one is taken in as well.

Pieces never span white space. So the new chunks of some texts are encoded together: each of their
different runs between white space is matched once, and all its pieces are merged side by side, one
merge a piece in each step. Ids are then gathered run by run.

The vocabulary is one of words with ends: text is composed (NFC), white space is dropped, letters
are lower-cased one by one, and the last letter of each piece carries the mark of the word's end.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import fresh, kept_fields
from tidemark.llm.token_counts import SPACE, _byte_letters

#: Bytes that the rolling hash sees, how many of its bits are zero at a cut, and the size of chunks.
WINDOW, CUT_BITS, SHORTEST, LONGEST = 16, 8, 64, 2048
#: Chunks that a worker keeps, and words at joins.
KEPT, WORDS = 8_000, 100_000
#: Letters of the texts whose chunks are encoded together, the most of these chunks, and pieces merged in one table.
AHEAD, MOST, ROWS = 3_000_000, 10_000, 4_096
#: Documents whose ids are held together.
TOGETHER = 1_000
#: Chunks of the table that is sent to all tasks: at most ``SHARED`` of ``LONGEST`` bytes.
SHARED = 8_192

#: The split pattern of this vocabulary (fixed value), with white space as Unicode has it.
PIECE = rf"""'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"""
#: No id.
NONE = 0xFFFF
#: Separators that ``str.split`` takes for white space and Unicode does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: The longest piece, in bytes, that is merged by scanning.
SHORT = 64
#: The longest alternative of fixed length in it: how far a piece's first letter looks ahead.
LOOK = 3

#: A number for each byte value, by a rule: what the rolling hash adds up.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=13) for b in range(256)], np.uint32)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of ``GEAR[byte k places back] << k`` over the last ``WINDOW`` bytes, modulo 2**32."""
    out, width = GEAR[data], 1
    while width < WINDOW:
        out[width:] += out[:-width] << np.uint32(width)
        width *= 2
    return out


def chunks(data: bytes, shortest: int = SHORTEST, longest: int = LONGEST, bits: int = CUT_BITS) -> list[bytes]:
    """``data`` (UTF-8) in chunks, none cut within a letter."""
    n = len(data)
    if n <= shortest:
        return [data] if n else []
    raw = np.frombuffer(data, np.uint8)
    starts_letter = (raw & 0xC0) != 0x80
    marked = (rolling_hash(raw) >> np.uint32(32 - bits)) == 0
    cuts = np.flatnonzero(marked[:-1] & starts_letter[1:]) + 1
    out, begin = [], 0

    def force(end: int) -> None:
        nonlocal begin
        while end - begin > longest:
            at = begin + longest
            while not starts_letter[at]:
                at -= 1
            at = at if at > begin else begin + longest + int(np.argmax(starts_letter[begin + longest :]))
            out.append(data[begin:at])
            begin = at

    for cut in cuts.tolist():
        if cut - begin >= shortest:
            force(cut)
            if cut > begin:
                out.append(data[begin:cut])
                begin = cut
    force(n)
    out.append(data[begin:])
    return out


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    ends = sizes.cumsum()
    return np.arange(sizes.sum()) + np.repeat(begins - ends + sizes, sizes)


@dataclass(slots=True)
class Encoded:
    """A chunk by itself: its ids, and the part of it that no following text can change, as a
    number of ids (``settled``) and the place where the first other piece begins (``tail``)."""

    text: str
    ids: array
    settled: int
    tail: int


class ChunkEncoder:
    """Encodes and decodes by one vocabulary file; keeps words, chunks and the table it was given."""

    def __init__(self, path: str, shortest: int = SHORTEST, longest: int = LONGEST, bits: int = CUT_BITS) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: What two ids merge to. Ids made by merges ascend with rank (checked), so the least id is the first merge.
        self.merge = {vocab[x] << 16 | vocab[y]: vocab[x + y] for x, y in reversed(merges)}
        made = [vocab[x + y] for x, y in merges]
        if any(m >= n for m, n in zip(made, made[1:])) or max(vocab.values()) >= NONE:
            raise ValueError("ids of the vocabulary have to follow its merges")
        pairs = np.array([*sorted(self.merge.items()), (2**32 - 1, NONE)], np.int64)
        self.pairs, self.pair_makes = pairs[:, 0].astype(np.uint32), pairs[:, 1].astype(np.uint16)
        letters = {b: c for c, b in _byte_letters().items()}
        self.inner, self.final = ([vocab[letters[b] + end] for b in range(256)] for end in ("", self.suffix))
        inner, final = np.array(self.inner, np.uint16), np.array(self.final, np.uint16)
        #: Ids of letters within a piece and at its end, and what two letters merge to in both places.
        self.letters = inner, final, np.stack([self.made_of(inner[:, None], end[None, :]) for end in (inner, final)])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.find_special = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        every = vocab | self.special
        self.token = [""] * (max(every.values()) + 1)
        for text, k in every.items():
            self.token[k] = text
        self.piece = regex.compile(PIECE)
        self.piece_or_line = regex.compile(PIECE + r"|\n")
        self.run = regex.compile(f"[^{SPACE}]+")
        self.sizes = (shortest, longest, bits)
        self.words: dict[str, bytes] = {}
        self.kept: dict[bytes, Encoded] = {}
        self.table: dict[bytes, Encoded] = {}

    def word(self, piece: str) -> bytes:
        """Ids of one piece, two bytes each."""
        found = self.words.get(piece)
        if found is None:
            found = array("H", self.pieced(piece.encode())).tobytes()
            if len(piece) <= SHORT:
                if len(self.words) >= WORDS:
                    self.words.clear()
                self.words[piece] = found
        return found

    def pieced(self, data: bytes) -> list[int]:
        ids = [self.inner[b] for b in data]
        ids[-1] = self.final[data[-1]]
        return self.merged(ids) if len(ids) <= SHORT else self.merged_long(ids)

    def merged(self, ids: list[int]) -> list[int]:
        """Merges, lowest rank first, leftmost among equals."""
        merge = self.merge.get
        made = [merge(a << 16 | b, NONE) for a, b in zip(ids, ids[1:])]
        while made:
            best = min(made)
            if best == NONE:
                break
            k = made.index(best)
            ids[k] = best
            del ids[k + 1], made[k]
            if k:
                made[k - 1] = merge(ids[k - 1] << 16 | best, NONE)
            if k < len(made):
                made[k] = merge(best << 16 | ids[k + 1], NONE)
        return ids

    def merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for pieces of any length."""
        n, merge = len(ids), self.merge.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(made, k) for k, (a, b) in enumerate(zip(ids, ids[1:])) if (made := merge(a << 16 | b)) is not None]
        heapify(heap)
        while heap:
            made, k = heappop(heap)
            right = after[k]
            if ids[k] == NONE or right == n or merge(ids[k] << 16 | ids[right]) != made:
                continue  # one of the two has been merged since
            ids[k], ids[right], after[k] = made, NONE, after[right]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n:
                    again = merge(ids[left] << 16 | ids[after[left]])
                    if again is not None:
                        heappush(heap, (again, left))
        return [k for k in ids if k != NONE]

    def made_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What pairs of ids merge to, ``NONE`` where they do not."""
        pair = a.astype(np.uint32) << np.uint32(16) | b
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.pair_makes[at], np.uint16(NONE))

    def merged_together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``pieced`` for many: ids, and for each piece where its own begin and how many they are.

        Short ones are rows of a table, filled up with ``NONE``; each step merges once in every row.
        """
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        by_length = np.argsort(lengths, kind="stable")
        short = int(np.searchsorted(lengths[by_length], SHORT, "right"))
        places, sizes, found = [], [], []
        inner, final, at_first = self.letters
        for first in range(0, short, ROWS):
            row = by_length[first : min(first + ROWS, short)]
            length, width = lengths[row], int(lengths[row[-1]])
            raw = np.frombuffer(b"".join([pieces[k].ljust(width, b"\0") for k in row.tolist()]), np.uint8).reshape(-1, width)
            each = np.arange(len(row))
            ids, made = inner[raw], at_first[0, raw[:, :-1], raw[:, 1:]]
            ids[each, length - 1] = final[raw[each, length - 1]]
            two = length > 1
            made[each[two], length[two] - 2] = at_first[1, raw[each[two], length[two] - 2], raw[each[two], length[two] - 1]]
            ids[np.arange(width) >= length[:, None]] = NONE
            made[np.arange(1, width) >= length[:, None]] = NONE
            while len(row):
                ended = (made == NONE).all(1)
                if ended.any():
                    stands = ids[ended] != NONE
                    places.append(row[ended])
                    sizes.append(stands.sum(1))
                    found.append(ids[ended][stands])
                    row, ids, made = row[~ended], ids[~ended], made[~ended]
                    continue
                each, at = np.arange(len(row)), made.argmin(1)  # the leftmost among equals
                ids[each, at] = made[each, at]
                stays = np.ones(ids.shape, bool)
                stays[each, at + 1] = False
                ids = ids[stays].reshape(len(row), -1)
                stays = np.ones(made.shape, bool)
                stays[each, at] = False
                made = made[stays].reshape(len(row), -1)
                for some, k in ((at > 0, at - 1), (at < made.shape[1], at)):
                    x, y = each[some], k[some]
                    made[x, y] = self.made_of(ids[x, y], ids[x, y + 1])
        for k in by_length[short:].tolist():
            long = np.array(self.pieced(pieces[k]), np.uint16)
            places.append(np.array([k]))
            sizes.append(np.array([len(long)]))
            found.append(long)
        place, size = np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int64), *sizes])
        begins, own = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        begins[place], own[place] = size.cumsum() - size, size
        return np.concatenate([np.zeros(0, np.uint16), *found]), begins, own

    def runs(self, text: str) -> list[str]:
        """What stands between white space."""
        return self.run.findall(text) if any(c in text for c in SEPARATORS) else text.split()

    def encode_chunks(self, parts: list[bytes]) -> list[Encoded]:
        """Each chunk by itself."""
        texts = [data.decode() for data in parts]
        runs = list(map(self.runs, texts))
        coded = pa.array(chain.from_iterable(runs), pa.string()).dictionary_encode()
        different, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        pieces = self.piece_or_line.findall("\n".join(different))
        lines = [-1, *(k for k, piece in enumerate(pieces) if piece == "\n"), len(pieces)]
        many = np.diff(np.array(lines)) - 1  # pieces of each run
        ids, begins, sizes = self.merged_together([piece.encode() for piece in pieces if piece != "\n"])
        of_piece = spread((many.cumsum() - many)[which], many[which])
        all_ids = ids[spread(begins[of_piece], sizes[of_piece])].tobytes()
        ends = np.append(0, sizes[of_piece].cumsum())[np.append(0, many[which].cumsum())]  # of the runs' ids
        run_ends = np.fromiter(accumulate(map(len, runs), initial=0), np.int64, len(runs) + 1)
        at, before = ends[run_ends].tolist(), ends[np.maximum(run_ends - 1, 0)].tolist()
        out = []
        for k, text in enumerate(texts):
            settled, tail = at[k + 1] - at[k], len(text)
            if runs[k] and text.endswith(last := runs[k][-1]):  # of this run, pieces stand that end before the chunk does
                settled, begin = before[k + 1] - at[k], len(text) - len(last)
                tail = begin
                for m in self.piece.finditer(last):
                    if begin + m.start() + LOOK > len(text) or begin + m.end() == len(text):
                        break
                    settled, tail = settled + len(self.word(m[0])) // 2, begin + m.end()
            out.append(Encoded(text, array("H", all_ids[2 * at[k] : 2 * at[k + 1]]), settled, tail))
        return out

    def normalised(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final form of sigma
        return text.lower()

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Normalised text between special strings, and the ids of those."""
        at = 0
        for m in self.find_special.finditer(text) if self.find_special else ():
            yield self.normalised(text[at : m.start()]), None
            yield "", self.special[m[0]]
            at = m.end()
        yield self.normalised(text[at:]), None

    def cut(self, text: str) -> Iterator[bytes]:
        """All chunks of a text."""
        for segment, special in self.segments(text):
            if special is None:
                yield from chunks(segment.encode(), *self.sizes)

    def encode(self, text: str) -> array:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[array]:
        """The ids of each text."""
        out, ahead, size = [], [], 0
        for number, text in enumerate(texts, 1):
            ahead.append(text)
            size += len(text)
            if size >= AHEAD or number == len(texts):
                out.extend(self._encoded(ahead))
                ahead, size = [], 0
        return out

    def _encoded(self, texts: list[str]) -> Iterator[array]:
        cut = [[(chunks(s.encode(), *self.sizes), special) for s, special in self.segments(text)] for text in texts]
        met = dict.fromkeys(chunk for segments in cut for parts, _ in segments for chunk in parts)
        known = {chunk: found for chunk in met if (found := self.table.get(chunk) or self.kept.get(chunk)) is not None}
        new = [chunk for chunk in met if chunk not in known]
        for k in range(0, len(new), MOST):  # a very long text is not split into words as a whole
            known.update(zip(new[k : k + MOST], self.encode_chunks(new[k : k + MOST])))
        self.kept.update((chunk, known[chunk]) for chunk in new[-KEPT:])
        for old in list(self.kept)[: max(0, len(self.kept) - KEPT)]:
            del self.kept[old]
        for segments in cut:
            out = array("H")
            for parts, special in segments:
                if special is not None:
                    out.append(special)
                elif parts:
                    self._joined([known[chunk] for chunk in parts], out)
            yield out

    def _joined(self, parts: list[Encoded], out: array) -> None:
        """Append the ids of all chunks, their joins repaired."""
        left, first = parts[0], 0  # ids of ``left`` from ``first`` on stand
        open_text, wait, step = None, 0, 1  # text that is to be encoded again, or None; chunks to add before the next try
        for number, right in enumerate(parts[1:], 2):
            if open_text is None:
                out.extend(left.ids[first : left.settled])
                open_text, wait, step = [left.text[left.tail :]], 0, 1
            last = number == len(parts)
            wait -= 1
            if wait > 0 and not last:
                open_text.append(right.text)
                continue
            before = "".join(open_text)
            again, skipped = self._agreed(before, right, last)
            if skipped is None:  # twice as much text next time, so that a long text is not scanned too often
                open_text = [before, right.text]
                wait, step = step, 2 * step
            else:
                out.frombytes(b"".join(map(self.word, again)))
                left, first, open_text = right, skipped, None
        if open_text is not None:
            out.frombytes(b"".join(map(self.word, self.piece.findall("".join(open_text)))))
        else:
            out.extend(left.ids[first:])

    def _agreed(self, before: str, right: Encoded, last: bool) -> tuple[list[str], int | None]:
        """The pieces of ``before`` and ``right`` up to the first one that begins where a piece of
        ``right`` does, and the ids of ``right`` before that; None if there is none in time."""
        window, offset, pieces = before + right.text, len(before), []
        own, skipped = self.piece.finditer(right.text), 0
        mine = next(own, None)
        for m in self.piece.finditer(window):
            at = m.start() - offset
            if at >= 0:
                if not last and m.start() + LOOK > len(window):
                    break
                while mine is not None and mine.start() < at:
                    skipped += len(self.word(mine[0])) // 2
                    mine = next(own, None)
                if mine is not None and mine.start() == at:
                    return (pieces, skipped) if at <= right.tail else ([], None)
            pieces.append(m[0])
        return [], None

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by a space, as this vocabulary has no decoder; unknown ids are left out."""
        token = self.token
        return " ".join([token[k] for k in ids if 0 <= k < len(token) and token[k]])


@functools.cache
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def shared_chunks(docs: DataFrame, path: str, most: int = SHARED) -> dict[bytes, tuple]:
    """Encodings of the chunks that save most when encoded once: occurrences beyond the first, times length.

    Digests of all chunks of all documents are counted, ``most`` of them are chosen (ties by
    digest), and one copy of each text is encoded. What reaches the driver is at most ``most`` chunks of ``LONGEST`` bytes.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = encoder(path).cut
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                seen.update((xxhash.xxh3_64_intdigest(c) - 2**63, len(c)) for c in cut(text or ""))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in seen], pa.int64()), pa.array([n for _, n in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())],
                names=["digest", "size", "n"])

    texts = docs.select("text")
    counted = texts.mapInArrow(digests, "digest long, size int, n long").groupBy("digest").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    best = counted.where("n > 1").orderBy(((F.col("n") - 1) * F.col("size")).desc(), "digest").limit(most)
    wanted = frozenset(row.digest for row in best.select("digest").collect())
    if not wanted:
        return {}

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, sent = encoder(path).cut, set()
        for batch in batches:
            new = {}
            for text in batch.column(0).to_pylist():
                for chunk in cut(text or ""):
                    digest = xxhash.xxh3_64_intdigest(chunk) - 2**63
                    if digest in wanted and digest not in sent:
                        sent.add(digest)
                        new[digest] = chunk
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array(list(new.values()), pa.binary())], names=["digest", "chunk"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_chunks
        for batch in batches:
            done = encode(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([e.ids.tobytes() for e in done], pa.binary()), *(pa.array([getattr(e, f) for e in done], pa.int32()) for f in ("settled", "tail"))],
                names=["chunk", "ids", "settled", "tail"])

    once = texts.mapInArrow(chosen, "digest long, chunk binary").groupBy("digest").agg(F.min("chunk").alias("chunk")).select("chunk")
    rows = once.mapInArrow(encoded, "chunk binary, ids binary, settled int, tail int").collect()
    return {bytes(r.chunk): (bytes(r.ids), r.settled, r.tail) for r in rows}


def encode(docs: DataFrame, path: str, decoded: bool = False, keep_text: bool = True, reuse: bool = True) -> DataFrame:
    """``docs`` with ``token_ids``, and ``decoded`` (the text of those ids) if asked for.

    Ids are those of the vocabulary's library without added begin or end; special strings within
    texts become their ids, as is its default. A null text counts as empty: no ids, an empty
    decoded text. Rows are independent, repeated or not, and keep their columns; where ``docs``
    has columns of these names, the new ones get ``_`` appended. A text is held whole in its task,
    very long ones included, with a few bytes beside each byte of it. ``reuse`` False leaves out
    the corpus-wide table, which saves two reads.
    """
    names = fresh(docs, "token_ids", "decoded")
    kept = kept_fields(docs, keep_text)
    added = [T.StructField(names[0], T.ArrayType(T.IntegerType())), T.StructField(names[1], T.StringType())]
    schema = T.StructType(kept + added[: 1 + decoded])
    table = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, path) if reuse else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        codec.table = {
            chunk: Encoded(chunk.decode(), array("H", ids), settled, tail) for chunk, (ids, settled, tail) in table.value.items()
        }
        tokens = pa.array(codec.token, pa.string())
        for batch in (b.slice(k, TOGETHER) for b in batches for k in range(0, b.num_rows, TOGETHER)):
            found = codec.encode_all([t or "" for t in batch.column("text").to_pylist()])
            sizes = np.fromiter(accumulate(map(len, found), initial=0), np.int32, len(found) + 1)
            flat = np.concatenate([np.frombuffer(f, np.uint16) for f in found if f] or [np.zeros(0, np.uint16)])
            columns = [pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat.astype(np.int32)))]
            if decoded:
                each = pa.ListArray.from_arrays(pa.array(sizes), tokens.take(pa.array(flat)))
                columns.append(pc.binary_join(each, " "))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """``rows`` with ``decoded``: token strings of the ``ids`` joined by a space. Null ids give null."""
    schema = T.StructType([*rows.schema.fields, T.StructField(*fresh(rows, "decoded"), T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        for batch in batches:
            texts = [None if k is None else codec.decode(k) for k in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
