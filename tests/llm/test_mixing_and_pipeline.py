"""Pfair mixing and the pipeline's stages on odd input and against brute force."""

import collections

import corpus_pipeline
from tidemark.llm import langid, mixing


def test_every_prefix_is_within_one_block(sent):
    weights = [("a", 50.0), ("b", 30.0), ("c", 13.0), ("d", 6.5), ("e", 0.5)]
    slots = mixing.slots_per_period(sent.createDataFrame(weights, "source string, weight double"), 97)
    shares = {r.source: r.slots for r in slots.collect()}
    assert sum(shares.values()) == 97 and min(shares.values()) >= 1
    rows = sorted(mixing.period_schedule(slots).collect(), key=lambda r: r.in_period)
    assert [r.in_period for r in rows] == list(range(97))
    done = collections.Counter()
    for t, r in enumerate(rows, 1):
        assert r.nth == done[r.source]
        done[r.source] += 1
        assert all(abs(done[s] - t * w / 97) < 1 for s, w in shares.items())


def test_mix_keeps_all_rows(sent, odd_documents, no_documents):
    rows = [(k, "t", "hot" if k % 3 else f"s{k % 4}") for k in range(3000)]
    docs = sent.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, sent.createDataFrame([("hot", 1.0), ("s0", 2.0), ("s1", None), ("none", 5.0)], "source string, weight double"), 50, 4).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    assert len({r.mix_position for r in got}) == 3000
    by_slot = collections.defaultdict(set)
    for r in got:
        by_slot[r.mix_slot].add(r.source)
        assert r.mix_position // 4 == r.mix_slot
    assert all(len(s) == 1 for s in by_slot.values())
    odd = mixing.mix(odd_documents)
    assert odd.columns == [*odd_documents.columns, "mix_slot", "mix_position"]
    assert odd.count() == odd_documents.count() == odd.select("mix_position").distinct().count()
    assert mixing.mix(no_documents).count() == 0


def test_many_sources_lengthen_the_period(sent):
    weights = sent.createDataFrame([(f"s{k}", float(k)) for k in range(40)], "source string, weight double")
    slots = mixing.slots_per_period(weights, 10)
    assert slots.agg({"slots": "sum"}).first()[0] == 80 and mixing.period_schedule(slots).count() == 80


def deviation(weights, slots):
    """Largest distance of a source from its share of the weights after any number of slots."""
    total, done, worst = sum(weights.values()), collections.Counter(), 0.0
    for t, source in enumerate(slots, 1):
        done[source] += 1
        worst = max(worst, max(abs(done[s] - t * w / total) for s, w in weights.items()))
    return worst


def test_exact_mixture_follows_the_weights(sent):
    """301 sources over 20 periods of 1000 slots: no slot is empty, none is more than two blocks off."""
    weights = {"hot": 700.0} | {f"s{k:03}": 1.0 for k in range(300)}
    docs = sent.createDataFrame([(k, "hot" if k < 14000 else f"s{k % 300:03}") for k in range(20000)], "doc_id long, source string")
    got = mixing.mix_exact(docs, sent.createDataFrame(list(weights.items()), "source string, weight double"), 1).collect()
    by_slot = {r.mix_slot: r.source for r in got}
    assert sorted(by_slot) == list(range(20000))
    slots = [by_slot[t] for t in range(20000)]
    assert collections.Counter(slots[:1000])["hot"] in range(699, 702)
    assert deviation(weights, slots) < 2


def test_exact_mixture_at_any_time():
    """Odd weights, over hundreds of periods and with many sources."""
    for given, length in (
        ([0.7, 0.2999, 0.0001], 200_000), ([50, 30, 13, 6.5, 0.5], 200_000), ([1.618**-k for k in range(25)], 50_000),
        ([(k * 7919 % 101 + 1) ** 0.5 for k in range(500)], 5_000),
    ):
        weights = {k: float(w) for k, w in enumerate(given)}
        total, slots = sum(weights.values()), {}
        for source, begin, steps in mixing.timetable([(k, 1, w) for k, w in weights.items()]):
            for turn in range(int(length * weights[source] / total) + 3):
                at = begin + mixing.slot_of(turn, steps)
                assert at not in slots
                slots[at] = source
        assert set(range(length)) <= set(slots)
        assert deviation(weights, [slots[t] for t in range(length)]) < 2


def test_exact_mixture_keeps_all_rows(sent, odd_documents, no_documents):
    docs = sent.createDataFrame([(k, "hot" if k % 3 else f"s{k % 4}") for k in range(3000)], "doc_id long, source string")
    got = mixing.mix_exact(docs, sent.createDataFrame([("hot", 1.0), ("s0", 2.0), ("s1", None), ("s2", -1.0), ("none", 5.0)], "source string, weight double"), 4).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000)) and len({r.mix_position for r in got}) == 3000
    last = max(r.mix_slot for r in got if r.source in ("hot", "s0"))
    after = [r.mix_slot for r in got if r.source not in ("hot", "s0")]
    assert min(after) == last + 1 and {r.source for r in got} == {"hot", "s0", "s1", "s2", "s3"}
    odd = mixing.mix_exact(odd_documents)
    assert odd.columns == [*odd_documents.columns, "mix_slot", "mix_position"]
    assert odd.count() == odd_documents.count() == odd.select("mix_position").distinct().count()
    assert mixing.mix_exact(no_documents).count() == 0


def test_stages_keep_columns_and_take_odd_rows(sent, odd_documents, no_documents, tmp_path):
    sent.createDataFrame([(1, "a benchmark item of some words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd_documents, no_documents):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(sent, docs, str(tmp_path))
            assert out.columns[: len(docs.columns)] == docs.columns, name
            assert out.count() <= docs.count()


def test_pipeline_decisions(sent, tmp_path):
    passage = "here is a benchmark passage of well over thirteen different words to be found by all"
    clean = [f"text number {k} says " + " ".join(f"w{k * 31 + i}" for i in range(60)) for k in range(20)]
    near = clean[3].replace("says", "tells")
    rows = [(k, t, "en", f"s{k % 3}") for k, t in enumerate(clean)]
    rows += [(50, clean[0], "en", "s0"), (51, near, "en", "s1"), (52, "start " + passage + " end", "en", "s2"), (53, "12 34", "en", "s0"), (54, None, None, None)]
    sent.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    sent.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(sent, str(tmp_path)).collect()
    # Of exact copies the largest id stays, of near ones the smallest; 52 to 54 go.
    assert sorted(r.doc_id for r in got) == [*range(1, 20), 50]
    assert len({r.mix_position for r in got}) == 20
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and langid.UNKNOWN == "und"
