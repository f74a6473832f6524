"""The operators that judge one text at a time, against brute force or the library they answer for."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import chat, cross_entropy, decontaminate, ftrl, langid, pii, token_counts, words
from tidemark.llm.fm_index import FMIndex, suffix_array

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD_TEXTS = [
    "a  b", "don't we'll I've they're   \n\n x <|endoftext|> y!<|endoftext|>z'l", "  ", "   \t a   'll", "é ü 🎉🎉 ñ́   x",
    "<|endoftext|><|endoft", "'''ll 're're", "x" * 200 + " " * 30 + "1234567890" * 9, "\x1c a \x1f  b", "a\u0085b　　c", "",
]


def test_suffix_array_and_search():
    rng = np.random.default_rng(5)
    for high in (2, 5, 300):
        seq = rng.integers(1, high, 500)
        order = suffix_array(np.append(seq, 0))
        raw = [*seq, 0]
        assert order.tolist() == sorted(range(len(raw)), key=lambda k: raw[k:])
        index = FMIndex(seq)
        for _ in range(30):
            a = int(rng.integers(0, 490))
            pattern = seq[a : a + int(rng.integers(1, 9))]
            padded = np.concatenate((np.full(9 - len(pattern), -1), pattern))[None]
            low, high_row = index.search(padded)
            found = index.locate(np.arange(low[0], high_row[0]))
            want = [k for k in range(len(seq)) if list(seq[k : k + len(pattern)]) == list(pattern)]
            assert sorted(found.tolist()) == want


def brute_contamination(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, names = find(text), set(), set()
    for item, t in items:
        b = find(t)
        for k in range(max(1, len(b) - 12) if b else 0):
            window = b[k : k + 13]
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    names.add("" if item is None else str(item))
    return len(w), len(hit), sorted(names)


def test_contamination_equals_brute_force(sent, odd_documents, monkeypatch):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh")
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([30, 13, 14, 3, 5, 60])]
    items += [(6, None), (7, "--"), (None, "the quick brown"), (1, items[1][1]), (10, "Größe ÜBER")]
    texts = [(k, " ".join(word() for _ in range(200)) + " " + items[k % 6][1].upper().replace(" ", rng.choice([" ", ", ", "\n"]))) for k in range(12)]
    rows = texts + [(r.doc_id, r.text) for r in odd_documents.filter("doc_id <> 7 and doc_id <> 8 or doc_id is null").collect()]
    docs = sent.createDataFrame(rows, "doc_id long, text string")
    bench = sent.createDataFrame(items, "item_id long, text string")
    want = sorted((str(d), *brute_contamination(t, items)) for d, t in rows)
    for size in (decontaminate.BLOCK_WINDOWS, 20):
        monkeypatch.setattr(decontaminate.blocks_of, "__defaults__", (size,))
        got = decontaminate.find_contamination(docs, bench).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got) == want
    for r in got:
        cut = "".join(r.text[s.start : s.end] + " " for s in r.spans)
        assert brute_contamination(cut, [])[0] == r.n_hit


def test_contamination_of_odd_tables(sent, odd_documents, no_documents):
    none = sent.createDataFrame([], "item_id long, text string")
    got = decontaminate.find_contamination(odd_documents, none)
    assert got.columns[: len(odd_documents.columns)] == odd_documents.columns
    assert got.agg({"n_hit": "sum"}).first()[0] == 0 and got.count() == odd_documents.count()
    assert decontaminate.find_contamination(no_documents, none).count() == 0


def test_token_counts_equal_the_library():
    library = Tokenizer.from_file(VOCABULARY)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    counter = token_counts.PrefixCounter(VOCABULARY)
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "'", "'l", "'ll", "re", "a", "Z", "é", "9", "<|endoftext|>", "<|", "!", "🎉", " the"]
    for text in [*ODD_TEXTS, *("".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(150))]:
        assert counter.count(text) == count(text)
        prefixes = counter.prefixes(text).tolist()
        assert prefixes == [count(text[:k]) for k in range(len(text) + 1)]
        assert counter.cut(text, 3) == max(k for k, n in enumerate(prefixes) if n <= 3)


def test_token_counts_of_odd_documents(odd_documents, no_documents):
    library = Tokenizer.from_file(VOCABULARY)
    docs = odd_documents.withColumnRenamed("score", "n_tokens")
    got = token_counts.count_tokens(docs, VOCABULARY, budget=4).collect()
    for r in got:
        text = r.text or ""
        assert r.n_bytes == len(text.encode()) and r.n_tokens_ == len(library.encode(text, add_special_tokens=False).ids)
        assert r.cut <= len(text) and len(library.encode(text[: r.cut], add_special_tokens=False).ids) <= 4
    assert token_counts.count_tokens(no_documents, VOCABULARY).count() == 0
    kept = token_counts.count_tokens(odd_documents.filter("doc_id = 9"), VOCABULARY, keep_prefixes=True, keep_text=False).first()
    assert "text" not in kept.asDict() and len(kept.prefix_tokens) == 31


def test_language_scores_by_plain_dictionaries(sent):
    import math
    import re
    from collections import Counter

    rng = random.Random(6)
    letters = {"aa": "abcde", "bb": "defgh", "cc": "ghéüa"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 7)))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n)) + " 12, " + word(lang).upper()
    train = [(k, text(lang, 30), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 15)]
    tests = [(k, text(rng.choice(list(letters)), rng.randint(1, 25)), None) for k in range(60)]
    words_in = lambda t: [w.decode() for w in re.findall(rb"[a-z\x80-\xff]+", t.encode().lower())]
    grams_in = lambda w, n: [p for p in (f"\0{w}\0"[k : k + n] for k in range(len(w) + 3 - n)) if len(p) == n and p != "\0"]
    tables = [{lang: Counter() for lang in letters} for _ in range(6)]
    for _, t, lang in train:
        for w in words_in(t):
            tables[0][lang][w] += 1
            for n in range(1, 6):
                tables[n][lang].update(grams_in(w, n))
    known = [set().union(*table.values()) for table in tables]
    log_of = lambda n, key, lang: math.log(tables[n][lang][key] + langid.PSEUDO) - math.log(sum(tables[n][lang].values()) + langid.PSEUDO * (len(known[n]) + 1))

    def scores(t):
        sums = dict.fromkeys(letters, 0.0)
        for w in words_in(t):
            n, keys = 0, [w] if w in known[0] else []
            for n in [0] if keys else range(5, 0, -1):
                keys = keys or [g for g in grams_in(w, n) if g in known[n]]
                if keys:
                    break
            for lang in sums:
                sums[lang] += sum(log_of(n, key, lang) for key in keys) / max(1, len(keys))
        return sums

    schema = "doc_id long, text string, lang string"
    model = langid.fit(sent.createDataFrame(train, schema))
    got = {r.doc_id: r for r in langid.identify(sent.createDataFrame(tests, schema), model).collect()}
    for k, t, _ in tests:
        sums = scores(t)
        best = max(sums, key=sums.get)
        share = 1 / sum(math.exp((s - sums[best]) / math.sqrt(len(words_in(t)))) for s in sums.values())
        assert got[k].lang_pred == best and abs(got[k].score - share) < 1e-3


def test_language_by_words_and_by_ngrams(sent, odd_documents, no_documents):
    rng = random.Random(2)
    stems = {"en": ["the", "and", "ing", "tion"], "xx": ["zaz", "üro", "kkö", "qua"]}
    make = lambda lang, n: " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(k, make(lang, 40), lang) for k, lang in enumerate(["en", "xx"] * 40)]
    train = sent.createDataFrame([*rows, (900, None, "en"), (901, "text", None), (902, "", "yy")], "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert set(model.languages) == {"en", "xx"}
    tests = [(k, make(lang, 12) + " " + "".join(stems[lang]) * 2, lang) for k, lang in enumerate(["en", "xx"] * 20)]
    got = langid.identify(sent.createDataFrame(tests, "doc_id long, text string, lang string"), model).collect()
    assert all(r.lang == r.lang_pred and 0.5 < r.score <= 1 for r in got)
    odd = langid.identify(odd_documents, model)
    assert odd.columns == [*odd_documents.columns, "lang_pred", "score_"]
    by = {r.doc_id: (r.lang_pred, r.score_) for r in odd.collect()}
    assert by[2] == by[3] == by[5] == by[6] == ("und", 0.0) and by[9][0] in ("en", "xx")
    empty = langid.fit(no_documents)
    assert {r.lang_pred for r in langid.identify(odd_documents, empty).collect()} == {"und"}
    assert langid.identify(no_documents, model).count() == 0


def test_unseen_words_back_off():
    spelled = words.Chunk(0, np.frombuffer("über".encode(), np.uint8), np.array([0, 5]))
    found = words.words_of(spelled, langid.LETTERS)
    letters = langid.spell(spelled.data, found.start, found.end)
    assert [len(langid.grams(letters, n)[0]) for n in range(1, 6)] == [4, 5, 4, 3, 2]


def test_classifier_learns_and_takes_odd_rows(sent, odd_documents, no_documents):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for _ in range(30))
    bad = lambda: " ".join(rng.choice(["ALPHA!!", "BETA!!", "the$$$", "of%%%"]) for _ in range(30))
    rows = [(k, good() if k % 3 else bad()) for k in range(300)]
    docs = sent.createDataFrame(rows, "doc_id long, text string")
    labels = sent.createDataFrame([(k, int(k % 3 > 0)) for k in range(0, 300, 2)] + [(0, None), (None, 1), (2, 0)], "doc_id long, label int")
    model = ftrl.fit(docs, labels)
    got = ftrl.score(docs, model).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 3 > 0) for r in got)
    odd = ftrl.score(odd_documents, model)
    assert odd.columns == [*odd_documents.columns, "score_"]
    by = {r.doc_id: r.score_ for r in odd.collect()}
    assert by[2] == by[3] == by[5] and all(0 <= s <= 1 for s in by.values())
    blank = ftrl.fit(no_documents, labels)
    assert {r.score_ for r in ftrl.score(odd_documents, blank).collect()} == {0.5}
    assert ftrl.score(no_documents, model).count() == 0


def test_cross_entropy_equals_brute_force(sent, odd_documents, no_documents):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice("abcdefghij"[: 5 + 5 * (k % 2)]) for _ in range(20))) for k in range(40)]
    rows += [(r.doc_id, r.text) for r in odd_documents.filter("doc_id in (2, 3, 5)").collect()]
    docs = sent.createDataFrame(rows, "doc_id long, text string")
    target = sent.createDataFrame([(k,) for k in range(0, 40, 2)] * 2, "doc_id long")
    models = cross_entropy.fit(docs, target, words=10)
    letters = "abcdefghij"
    counts = np.zeros((2, 35, 34))
    for d, text in rows:
        seq = [*map(letters.index, (text or "").split())]
        for h, w in zip([34, *seq], seq, strict=False):
            counts[1, h, w] += 1
            counts[0, h, w] += d % 2 == 0
    counts[1] *= counts[0].sum() / counts[1].sum()
    losses = []
    for c in counts:
        one = (c.sum(0) + 1) / (c.sum() + 34)
        losses.append(-np.log((c + 8 * one) / (c.sum(1, keepdims=True) + 8)))
    for r in cross_entropy.score(docs, models).collect():
        seq = [*map(letters.index, (r.text or "").split())]
        want = [np.mean([m[h, w] for h, w in zip([34, *seq], seq, strict=False)]) if seq else 0 for m in losses]
        assert r.n_words == len(seq)
        assert np.allclose([r.target_loss, r.background_loss, r.score], [*want, want[0] - want[1]], atol=1e-5)
    odd = cross_entropy.score(odd_documents, cross_entropy.fit(odd_documents, no_documents.select("doc_id")))
    assert odd.count() == odd_documents.count() and "score_" in odd.columns
    assert cross_entropy.score(no_documents, cross_entropy.fit(no_documents, target)).count() == 0



@pytest.mark.parametrize(("frequent", "hot", "held"), [(0, 0, 100), (20, 0, 1 << 21), (20, 30, 300), (1 << 12, 1 << 16, 1 << 21)])
def test_cross_entropy_of_counted_documents_equals_the_models(sent, odd_documents, no_documents, monkeypatch, frequent, hot, held):
    """Copies, repeated and null ids, texts of one word and none; frequent words and bigrams in every document."""
    for name, value in (("FREQUENT", frequent), ("HOT", hot), ("HELD", held), ("SENT", held), ("PARTS", 7)):
        monkeypatch.setattr(cross_entropy, name, value)
    rng = random.Random(13)
    rows = [(k, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(60)))) for k in range(120)]
    rows += [(500 + k, rows[5][1]) for k in range(9)] + [(7, "w1 w1 w1 w2"), (None, rows[6][1]), (600, "W1"), (601, "w1"), (602, "only"), (603, None), (604, " ")]
    docs = sent.createDataFrame(rows, "doc_id long, text string")
    target = sent.createDataFrame([(k,) for k in [*range(0, 120, 2), 500, 7, 7, None]], "doc_id long")

    def rounded(df):
        return sorted((str(r.doc_id), str(r.text), r.n_words, *(round(x, 8) + 0.0 for x in r[-3:])) for r in df.collect())

    got = rounded(cross_entropy.score_counted(docs, target))
    want = rounded(cross_entropy.score(docs, cross_entropy.fit(docs, target)))
    assert len(got) == len(want) == len(rows)
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and np.allclose(a[3:], b[3:], atol=1e-7)
    odd = cross_entropy.score_counted(odd_documents, no_documents.select("doc_id"))
    assert odd.columns == cross_entropy.score(odd_documents, cross_entropy.fit(odd_documents, no_documents.select("doc_id"))).columns
    assert odd.count() == odd_documents.count()
    assert cross_entropy.score_counted(no_documents, target).count() == 0


@pytest.mark.parametrize("hot", [0, 50, 1 << 16])
def test_cross_entropy_keeps_every_word(sent, monkeypatch, hot):
    """1,500 words, each as rare as the others, in the corpus and in texts of which a part is unseen."""
    monkeypatch.setattr(cross_entropy, "HOT", hot)
    rng = random.Random(11)
    rows = [(k, " ".join(f"w{rng.randrange(750) + 750 * (k % 2)}" for _ in range(40))) for k in range(200)]
    rows += [(200, rows[3][1]), (201, rows[3][1])]
    other = [(300, "w1 w2 neverseen w760 w1 w2"), (301, rows[4][1]), (302, None), (302, "")]
    docs, more = (sent.createDataFrame(r, "doc_id long, text string") for r in (rows, other))
    models = cross_entropy.fit(docs, sent.createDataFrame([(k,) for k in range(0, 200, 2)], "doc_id long"))
    pair, single, begin = [[collections.Counter() for _ in range(2)] for _ in range(3)]
    for d, text in rows:
        seq = text.split()
        for h, w in zip(["", *seq], seq, strict=False):
            for k in range(2):
                n = 1 if k else int(d < 200 and d % 2 == 0)
                pair[k][h, w] += n
                single[k][w] += n
                begin[k][h] += n
    total = [sum(s.values()) for s in single]
    scale, width = (1.0, total[0] / total[1]), len(single[1]) + 1

    def loss(k, h, w):
        one = (single[k][w] * scale[k] + 1) / (total[0] + width)
        return -np.log((pair[k][h, w] * scale[k] + 8 * one) / (begin[k][h] * scale[k] + 8))

    for given in (docs, more):
        got = cross_entropy.score(given, models).collect()
        assert len(got) == given.count()
        for r in got:
            seq = (r.text or "").split()
            want = [np.mean([loss(k, h, w) for h, w in zip(["", *seq], seq, strict=False)]) if seq else 0 for k in range(2)]
            assert r.n_words == len(seq)
            assert np.allclose([r.target_loss, r.background_loss, r.score], [*want, want[0] - want[1]], atol=1e-6)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    def luhn(digits):
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0

    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".") if kind == "ip"),
                    "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            out += [(kind, m.start(), m.end())] if good else []
    return out


def test_base_spans_equal_brute_force(sent, odd_documents, no_documents):
    rng = random.Random(8)
    parts = ["a.b@c.d", "@", "x@y", ".z", "1.2.3.4", "300.1.1.1.1", ".5", "4012-8888 8888-1881", "4012888888881881", "-", " ", "  ", "7", "00",
             "+1 (202) 555-0143", "+", "é", "🎉", "_", "%", "\n", "378282246310005", "0.0.0.256", "(", "9" * 21, "@mail.example.com"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    texts += ["1" * 50_000, "1 " * 20_000, "a" * 50_000, "a@" + "b." * 20_000, "1.2." * 20_000, "+1" + " 2" * 20_000]
    docs = sent.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in pii.find_personal_data(docs).collect()}
    for k, text in enumerate(texts[:400]):
        assert got[k] == brute_base(text), text
    assert got[402] == [] and got[400] == []
    odd = pii.find_personal_data(odd_documents)
    assert odd.count() == odd_documents.count() and pii.find_personal_data(no_documents).count() == 0


def test_contexts_discover_unseen_identifiers(sent):
    rng = random.Random(9)
    rows = [(k, f"{rng.choice(['so', 'then', 'now'])} please write to user{k}@mail.example.com about it {k}th") for k in range(30)]
    place = len("do please write to ")
    rows += [(100, "do please write to someone7(at)example soon"), (101, "the 15th of May, 3rd place"), (102, None), (103, "please write to 🎉x9 ok")]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_personal_data(sent.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == [("email", place, place + len("someone7(at)example"))] and got[103] == [("email", 16, 19)]
    assert got[101] == [] and got[102] == []
    assert all(len(got[k]) == 1 for k in range(30))


def test_chat_round_trip(sent):
    t = chat.CHAT
    for text in ["</s>[INST] ok [/INST]", "<\\/s> <\\\\/s> <|im_end|>", "[[INST]]", "<|im_<|im_end|>", "plain", ""]:
        escaped = t.escape(text)
        assert t.unescape(escaped) == text
        assert not any(c in escaped for c in (t.open, t.middle, t.close, *t.other_control))
    with pytest.raises(ValueError):
        chat.Template(open="aa")
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "</s> hi"), (2, 1, "assistant", "b"), (2, 0, "user", "<|im_end|>"),
        (3, 0, "assistant", "first"), (3, None, "user", "null turn"), (4, 0, "user", "same"), (4, 0, "user", "same"), (None, 0, None, None), (5, 0, "<s>", "x"),
    ]
    conversations = sent.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = chat.format_segments(conversations)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, r in got.items():
        turns = sorted((x for x in rows if x[0] == conv), key=order)
        said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns)
        loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (
            len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(s.text) for s in segments.collect() if s.conv_id == conv)
    assert {c for c, r in got.items() if r.valid} == {1, 2, 3}
    assert chat.read_back(chat.format_segments(conversations.filter("false"))).count() == 0


def test_words_and_shingles():
    texts = ["A bB\tccc é", "", "x", "🎉 y z"]
    import pyarrow as pa

    chunk = next(words.chunks_of(pa.array([*texts, None])))
    found = words.words_of(chunk, words.NOT_SPACE)
    assert np.bincount(found.doc, minlength=5).tolist() == [4, 0, 1, 2, 0]
    again = next(words.chunks_of(pa.array(["a BB ccc é"])))
    assert words.words_of(again, words.NOT_SPACE).hash.tolist() == found.hash[:4].tolist()
    assert [c.n for c in words.chunks_of(pa.array(["a" * 30] * 5), size=64)] == [2, 2, 1]
