"""Exact dedup and the Jaccard join against brute force, and on odd input."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import exact_dedup, jaccard_join
from tidemark.llm.components import connected


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows):
    """Smallest id reachable, for (id, text) rows with distinct ids."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in ids}, {d: len(s) for d, s in sets.items()}


def near_copies(seed, groups=6, size=25):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    common = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 120]))]
        if rng.random() < 0.5:
            base = common + base
        for _ in range(size):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice([[], ["edited" + str(rng.random())], [own[k], "more"]])
            rows.append((len(rows), " ".join(own)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(sent, seed):
    rows = near_copies(seed)
    got = jaccard_join.near_duplicates(sent.createDataFrame(rows, "doc_id long, text string")).collect()
    component, size = brute_components(rows)
    assert {r.doc_id: r.component_id for r in got} == component
    assert {r.doc_id: r.n_shingles for r in got} == size
    assert len(got) == len(rows)


def test_links_between_components_are_found(sent, monkeypatch):
    """Without the pivot step everything has to come from the comparison of components."""
    rows = near_copies(7, groups=4, size=20)
    docs = sent.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "_pivot_links", lambda postings, members, percent: postings.selectExpr("node as a", "node as b").limit(0))
    component, _ = brute_components(rows)
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()} == component


def test_pruning_keeps_every_linked_pair_of_sizes():
    """All sizes up to 300, what only one of the two sets has at the lowest or the highest hashes."""
    percent = 80
    for n in range(1, 301):
        for m in range(n, 100 * n // percent + 1):
            shared = -(-percent * (n + m) // (100 + percent))
            if shared > n:
                continue
            low_n, low_m = n - shared, m - shared
            for first_n in (0, low_n):
                for first_m in (0, low_m):
                    # The shared ones are next to each other: those of a prefix are the first of them.
                    met = min(
                        min(max(jaccard_join._prune_prefix(n, percent) - first_n, 0), shared),
                        min(max(jaccard_join._prune_prefix(m, percent) - first_m, 0), shared))
                    assert met >= jaccard_join._prune_matches(n, percent), (n, m)
                    assert met >= jaccard_join._prune_matches(m, percent), (n, m)


def test_link_with_extra_shingles_at_the_lowest_hashes(sent):
    """9 shingles inside 11, the two others lowest: the prefixes of 3 meet once."""
    from tidemark.llm.words import NOT_SPACE, chunks_of, shingle_sets

    def hashes(text):
        return next(s for c in chunks_of(pa.array([text])) for s, _ in shingle_sets(c, NOT_SPACE, 5))

    rows = []
    for k in range(20_000):
        text = " ".join(f"t{k}w{i}" for i in range(13))
        more = f"{text} t{k}y t{k}z"
        extra = set(hashes(more)) - set(hashes(text))
        if extra <= set(hashes(more)[:3]):
            rows += [(2 * len(rows), text), (2 * len(rows) + 1, more)]
        if len(rows) == 20:
            break
    assert len(rows) == 20
    got = jaccard_join.near_duplicates(sent.createDataFrame(rows, "doc_id long, text string")).collect()
    component, _ = brute_components(rows)
    assert len(set(component.values())) == 10
    assert {r.doc_id: r.component_id for r in got} == component


@pytest.mark.parametrize("block", [4, 256])
def test_numbers_of_links_equal_brute_force(sent, odd_documents, no_documents, monkeypatch, block):
    """All links count, also those inside a group of near copies, and rows of equal sets one by one."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_copies(5, groups=4, size=20)
    got = jaccard_join.near_duplicates(sent.createDataFrame(rows, "doc_id long, text string"), links=True).collect()
    sets = {d: shingles(t) for d, t in rows}
    want = {a: sum(a != b and 100 * len(x & y) >= 80 * len(x | y) for b, y in sets.items()) for a, x in sets.items()}
    assert {r.doc_id: r.n_links for r in got} == want and len(got) == len(rows)
    assert max(want.values()) > 4 and any(0 < want[a] < max(want.values()) for a in want)
    by = collections.defaultdict(list)
    for r in jaccard_join.near_duplicates(odd_documents, links=True).collect():
        by[r.doc_id].append(r.n_links)
    assert by[1] == [1, 1] and by[2] == by[3] == by[5] == [0] and by[7] == by[8] == [1] and by[None] == [1]
    assert jaccard_join.near_duplicates(no_documents, links=True).count() == 0


def test_levels_trade_prefix_for_matches():
    assert jaccard_join.choose_level(np.array([2] * 50), 1, 100) == 1
    assert jaccard_join.choose_level(np.array([2000] * 50), 10, 100) > 1


def test_odd_documents(odd_documents, no_documents):
    got = jaccard_join.near_duplicates(odd_documents)
    assert got.count() == odd_documents.count()
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append((r.n_shingles, r.component_id))
    assert by[2] == [(0, 2)] and by[3] == [(0, 3)] and by[5] == [(0, 5)]
    assert by[None] == [(1, 4)] and (1, 4) in by[4]
    assert by[8][0][1] == 7
    kept = jaccard_join.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == [1, 2, 3, 4, 4, 5, 6, 7, 9]
    assert jaccard_join.near_duplicates(no_documents).count() == 0
    assert jaccard_join.keep_one(no_documents).columns == no_documents.columns


def test_components_of_chains_and_stars(sent):
    links = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in connected(sent.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(21)) and all(got[k] == 100 for k in range(100, 140))
    assert connected(sent.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bucket_bytes", [200, 32 << 20])
def test_exact_groups(odd_documents, bucket_bytes):
    index = exact_dedup.build_index(odd_documents, bucket_bytes)
    got = exact_dedup.assign(odd_documents, index).collect()
    texts = collections.defaultdict(list)
    for r in odd_documents.collect():
        texts[r.text or ""].append(r.doc_id)
    want = collections.Counter()
    for text, ids in texts.items():
        keep = max((i for i in ids if i is not None), default=None)
        for k, i in enumerate(ids):
            want[i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(texts)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.keep_one(odd_documents, index)
    assert kept.columns == odd_documents.columns and kept.count() == len(texts)


def test_directory_splits_and_pages(sent):
    rows = [(k, f"text {k % 50}" if k % 3 else "the same") for k in range(600)]
    docs = sent.createDataFrame(rows, "doc_id long, text string")
    cells = exact_dedup.directory(docs, 2000).collect()
    assert max(c.depth for c in cells) == exact_dedup.MAX_DEPTH and max(c.pages for c in cells) > 1
    assert len({c.depth for c in cells}) > 1
    got = exact_dedup.exact_dedup(docs, 2000)
    assert got.filter("kept").count() == len({t for _, t in rows})
    assert got.agg({"group_size": "max"}).first()[0] == 200


def test_exact_dedup_of_nothing(no_documents):
    assert exact_dedup.exact_dedup(no_documents).count() == 0
    assert exact_dedup.keep_one(no_documents, exact_dedup.build_index(no_documents)).count() == 0
