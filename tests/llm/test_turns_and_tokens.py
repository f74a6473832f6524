"""Conversation repair, token alignment and chunked BPE against brute force and the tokenizers' libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chunked_bpe, token_alignment, turn_repair

WORDS_PATH = public_tokenizers.path("word_bpe_49k.json")
BYTES_PATH, PIECES_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = ["a", "B", "é", "é", "'", "'re", "'S", " ", "\n", "\x1c", "1", "Σ", "İ", "한", "🎉", "-", "<|endoftext|>", "<|", "ß", "Å", "the",
           "̈", "中文", "▁", "<s>", "<0x0A>", "​", "﻿", "12345", "\t\t"]


def random_texts(n, longest, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


# conversations

def edits_by_dynamic_program(rows):
    best = {turn_repair.START: (0, ""), turn_repair.SYSTEM: (6, "II"), turn_repair.USER: (3, "I"), turn_repair.ASSISTANT: (0, "")}
    for row in reversed(rows):
        kept = {q: min((c + best[to][0], e + best[to][1]) for e, c, taken, to in turn_repair.ARCS[row][q] if taken) for q in range(4)}
        best = {}
        for q in range(4):
            once = turn_repair.TURN_BY_EDIT[q]
            twice = turn_repair.TURN_BY_EDIT[once]
            best[q] = min(kept[q], (3 + kept[once][0], "I" + kept[once][1]), (6 + kept[twice][0], "II" + kept[twice][1]))
    return best[turn_repair.START]


def test_auction_finds_the_least_edits():
    rng = random.Random(1)
    for _ in range(1500):
        rows = "".join(rng.choice("suaxSUAX--uaua") for _ in range(rng.randint(0, 50)))
        assert turn_repair.cheapest_edits(rows) == edits_by_dynamic_program(rows)


def test_auction_on_long_conversations():
    rng = random.Random(2)
    for rows in ("ua" * 20_000, "".join(rng.choice("suaxSUAX--uaua") for _ in range(20_000)), "-" * 5_000, "s" * 3_000):
        assert turn_repair.cheapest_edits(rows) == edits_by_dynamic_program(rows)


def test_repaired_turns(sent):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hi there!"), (1, 3, "assistant", "Hello"), (1, 3, "assistant", "Hello"), (1, 4, "user", " \t"),
        (2, None, None, None), (2, 5, "tool", "x."), (None, 1, "assistant", "Well."), (3, 0, "user", "Q?"), (3, 1, "assistant", "A."),
    ]
    turns = sent.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    plans = turn_repair.plan_edits(turns)
    got = {r.conv_id: r for r in plans.collect()}
    assert (got[1].audit, got[1].cost, got[1].gaps, got[1].blank, got[1].duplicate, got[1].truncated, got[1].illegal) == ("KKKDD", 11, 1, 1, 1, 1, 1)
    assert (got[2].audit, got[2].cost, got[2].gaps, got[2].blank) == ("DD", 8, 0, 1)
    assert (got[None].audit, got[None].cost) == ("IK", 3)
    assert (got[3].audit, got[3].cost, got[3].letters) == ("KK", 0, "ua")
    out = turn_repair.repaired(turns, plans).collect()
    kept = {c: [(r.position, r.role, r.text, r.edit) for r in out if r.conv_id == c and r.role is not None] for c in (1, 2, None, 3)}
    assert kept[None] == [(0, "user", "", "I"), (1, "assistant", "Well.", "K")] and kept[2] == []
    assert [k[1] for k in kept[1]] == ["system", "user", "assistant"]
    closing = {r.conv_id: r.repaired_sha256 for r in out if r.repaired_sha256}
    assert closing[3] == hashlib.sha256(b"user:Q?\nassistant:A.").hexdigest() and closing[2] == hashlib.sha256(b"").hexdigest()


def test_a_conversation_with_most_rows(sent):
    rows = sent.range(6_000).select(
        F.when(F.col("id") < 5_000, 7).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), "id", F.lit(".")).alias("text"))
    plans = turn_repair.plan_edits(rows)
    hot = plans.where("conv_id = 7").first()
    assert (hot.cost, hot.audit) == edits_by_dynamic_program(hot.letters) and len(hot.letters) == 5_000
    turns = [r for r in turn_repair.repaired(rows, plans).where("conv_id = 7 and role is not null").collect()]
    assert [t.position for t in turns] == list(range(len(turns))) and [t.role[0] for t in turns] == ["u", "a"] * (len(turns) // 2)


def test_no_conversations(sent):
    none = sent.createDataFrame([], "conv_id long, turn long, role string, text string")
    plans = turn_repair.plan_edits(turn_repair.damage(none))
    assert plans.count() == 0 and turn_repair.repaired(none, plans).count() == 0


# alignment

def test_shared_cuts():
    rng = random.Random(3)
    for _ in range(2000):
        n = rng.randint(1, 300)
        a, b = (sorted({x for x in range(1, n) if rng.random() < d} | {n}) for d in (rng.random(), rng.random()))
        if rng.random() < 0.3:
            b = [x for x in b if x < n // 8 or x == n]
        assert [a[k] for k in token_alignment.shared_cuts(np.array(a), np.array(b))] == sorted(set(a) & set(b))
    assert len(token_alignment.shared_cuts(np.zeros(0, int), np.zeros(0, int))) == 0


def aligned_by_overlap(texts):
    tok = token_alignment.loaded(BYTES_PATH, PIECES_PATH)
    rows, counts = [], Counter()
    for text in texts:
        a, b = tok.encode([text])[0] if text else ([], [])
        spans = []
        for ids, table in ((a, tok.bytes_a), (b, tok.bytes_b)):
            at, out = 0, []
            for k in ids:
                out.append((at, at + len(table[k]), k))
                at += len(table[k])
            spans.append(out)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        low, groups = 0, []
        for cut in sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]}):
            groups.append("|".join(",".join(str(k) for _, end, k in side if low < end <= cut) for side in spans))
            low = cut
        counts.update(links)
        rows.append((len(a), len(b), len(groups), links, ";".join(groups)))
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [(a, b, g, len(ln), sum(counts[k] == highest[k[1]] for k in ln), sum(counts[k] for k in ln), s) for a, b, g, ln, s in rows]


def test_alignment_equals_overlaps(sent, monkeypatch):
    texts = [*random_texts(120, 40, 4), "plain words that align well enough", None, "", "same text", "same text", "x" * 300, "ab ab ab " * 100]
    docs = sent.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, n_a string").repartition(3)
    out = {r.doc_id: r for r in token_alignment.align(docs, BYTES_PATH, PIECES_PATH).collect()}
    wanted = aligned_by_overlap(texts)
    assert len(out) == len(texts) and out[0].n_a == "clash"
    for k, want in enumerate(wanted):
        r = out[k]
        assert (r.n_a_, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) == want


def test_alignment_of_odd_documents(odd_documents, no_documents):
    out = token_alignment.align(odd_documents, BYTES_PATH, PIECES_PATH, groups="sha256")
    assert out.columns == [*odd_documents.columns, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    rows = out.collect()
    assert len(rows) == 12 and all(r.n_links == r.n_a + r.n_b - r.n_groups for r in rows)
    assert {(r.n_a, r.count_sum, r.groups) for r in rows if not r.text} == {(0, 0, "")}
    assert token_alignment.align(no_documents, BYTES_PATH, PIECES_PATH).count() == 0


# chunked BPE

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS_PATH)


@pytest.mark.parametrize(("shortest", "longest", "bits"), [(64, 2048, 8), (1, 8, 1), (4, 30, 2)])
def test_chunks_join_exactly(library, shortest, longest, bits):
    codec = chunked_bpe.ChunkEncoder(WORDS_PATH, shortest, longest, bits)
    for text in random_texts(1200, 80, 5) + random_texts(40, 2000, 6) + ["a" * 9000, "'" * 500, "한" * 3000]:
        want = library.encode(text, add_special_tokens=False).ids
        assert list(codec.encode(text)) == want
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False)
        assert b"".join(chunked_bpe.chunks(text.encode(), shortest, longest, bits)) == text.encode()


def test_new_words_are_merged_together(library, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aabeinorstth'é한1.\x1c") for _ in range(rng.randint(1, 30)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(150)] + ["", "\x1d a\x1e\x1fb  ", "x" * 200 + " x"]
    codec = chunked_bpe.ChunkEncoder(WORDS_PATH)
    alone = []
    merged = codec.merged
    monkeypatch.setattr(codec, "merged", lambda ids: alone.append(ids) or merged(ids))
    found = codec.encode_all(texts)
    assert list(map(list, found)) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(alone) < 2 * sum(len(list(codec.cut(t))) for t in texts)  # at joins; 12,917 when each word was merged alone

    pieces = [bytes(rng.choice(b"abethin\xc3\xa9!") for _ in range(rng.randint(1, 90))) for _ in range(5000)]
    ids, begins, sizes = codec.merged_together(pieces)
    assert [ids[b : b + n].tolist() for b, n in zip(begins, sizes)] == list(map(codec.pieced, pieces))
    assert [len(part) for part in codec.merged_together([])] == [0, 0, 0]

    together, encode_chunks = [], codec.encode_chunks
    monkeypatch.setattr(chunked_bpe, "MOST", 50)
    monkeypatch.setattr(codec, "encode_chunks", lambda parts: together.append(len(parts)) or encode_chunks(parts))
    long = " ".join(word() for _ in range(4000))
    assert list(codec.encode(long)) == library.encode(long, add_special_tokens=False).ids
    assert max(together) == 50 and len(together) > 2


def test_equal_passages_are_cut_alike():
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdefghij klmno") for _ in range(8000)).encode()
    one, two = (set(chunked_bpe.chunks(lead + passage)) for lead in (b"some lead ", b"another and longer lead in front of it "))
    assert len(one & two) > 0.8 * len(one)


def test_encode_with_and_without_the_shared_table(odd_documents, no_documents, library):
    for reuse in (True, False):
        out = chunked_bpe.encode(odd_documents, WORDS_PATH, decoded=True, reuse=reuse)
        assert out.columns == [*odd_documents.columns, "token_ids", "decoded"]
        for r in out.collect():
            want = library.encode(r.text or "", add_special_tokens=False).ids
            assert r.token_ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
    assert chunked_bpe.encode(no_documents, WORDS_PATH).count() == 0
    again = chunked_bpe.decode(chunked_bpe.encode(odd_documents.select("text"), WORDS_PATH), WORDS_PATH)
    assert all(r.decoded == library.decode(r.token_ids, skip_special_tokens=False) for r in again.collect())


def test_shared_chunks_are_those_met_twice(sent):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefghij klmno") for _ in range(6000))
    docs = sent.createDataFrame([(k, f"{k} {rng.random()} {passage}" if k < 5 else f"alone {k}") for k in range(8)], "doc_id long, text string").repartition(4)
    table = chunked_bpe.shared_chunks(docs, WORDS_PATH)
    assert table and all(c.decode() in passage for c in table)
    assert len(chunked_bpe.shared_chunks(docs, WORDS_PATH, most=3)) == 3


def test_both_encodings_are_the_libraries_own():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTES_PATH), sentencepiece.SentencePieceProcessor(model_file=PIECES_PATH)
    a.encode_special_tokens = True
    tok = token_alignment.loaded(BYTES_PATH, PIECES_PATH)
    texts = [t for t in random_texts(1500, 50, 9) if t]
    for text, (ids_a, ids_b) in zip(texts, tok.encode(texts), strict=True):
        want_a, want_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelled = b"".join(tok.bytes_b[k] for k in want_b) == (" " + text).encode()
        assert (list(ids_a), list(ids_b)) == ((want_a, want_b) if spelled else ([], []))


def test_stored_segments_are_read_in_any_order(sent, tmp_path):
    from tidemark.llm import chat

    turns = sent.range(3000).select(
        F.when(F.col("id") < 2900, 1).otherwise(2).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t "), "id").alias("text"))
    segments = chat.format_segments(turns)
    segments.repartition(3, "text").write.parquet(str(tmp_path / "segments"))
    stored = sent.read.schema(segments.schema).parquet(str(tmp_path / "segments"))
    assert sorted(map(str, chat.read_stored(stored).collect())) == sorted(map(str, chat.read_back(segments).collect()))
    assert {r.conv_id: (r.n_turns, r.valid) for r in chat.read_stored(stored).collect()} == {1: (2900, True), 2: (100, True)}


def test_quality_training_step_by_step(sent):
    """One shard: every update and score by plain dictionaries, from the same features."""
    import math

    import pyarrow as pa

    from tidemark.llm import ftrl
    from tidemark.llm.words import chunks_of

    rng = random.Random(11)
    rows = [(k, " ".join(rng.choice(["good", "bad", "Page", "x1", "click", "ever"]) for _ in range(rng.randint(0, 12))), k % 2) for k in range(12)]
    docs = sent.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = sent.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, label int")
    model = ftrl.fit(docs, labels, shards=1, rounds=2)

    found = [f for c in chunks_of(pa.array([t for _, t, _ in rows])) for f in ftrl.features(c)]
    listed = [[*zip(p.tolist(), v.tolist()), (ftrl.DIMENSIONS, 1.0)] for p, v in found]
    z, n = Counter(), Counter()

    def weight(place):
        if abs(z[place]) <= ftrl.L1:
            return 0.0
        return -(z[place] - math.copysign(ftrl.L1, z[place])) / ((ftrl.BETA + math.sqrt(n[place])) / ftrl.ALPHA + ftrl.L2)

    def probability(features):
        return 1 / (1 + math.exp(-sum(weight(place) * value for place, value in features)))

    for _ in range(2):
        for features, (_, _, label) in zip(listed, rows, strict=True):
            error, before = probability(features) - label, {place: weight(place) for place, _ in features}
            for place, value in features:
                g = error * value
                z[place] += g - (math.sqrt(n[place] + g * g) - math.sqrt(n[place])) / ftrl.ALPHA * before[place]
                n[place] += g * g
    got = {r.doc_id: r.score for r in ftrl.score(docs, model).collect()}
    assert all(abs(got[k] - probability(listed[k])) < 1e-5 for k in got) and len(got) == 12
