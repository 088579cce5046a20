"""Operators against brute force, library round trips, held-out accuracy and odd rows."""

import hashlib
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import (languages, licenses, mixing, near_dups, nearest, personal_data, quality, repeats,
                           rules, sentencepieces)
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, h string"
WORDS = " ".join(f"word{i}" for i in range(60))
ODD = [(1, None, None, None, None, "x", "y"), (2, "", "en", "a", 0, "x", "y"), (3, WORDS, "en", "a", 1, "x", "y"),
       (4, WORDS, "en", "a", 1, None, "y"), (5, WORDS + " " * 3, None, "b", 1, "x", None),
       (None, WORDS, "en", None, 1, "x", "y"), (6, "ab " * 40_000, "en", "b", 1, "x", "y"),
       (7, "\n\t ", "en", "b", 1, "x", "y"), (3, WORDS, "en", "a", 1, "x", "y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_repeats(docs, texts):
    wanted = brute.repeated(list(texts.items()))
    for most in (20_000, 3):            # the second takes strings with many contexts apart
        got = repeats.digests(repeats.remove(docs, most=most)).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == wanted


def test_repeats_across_chunks(spark):
    rng = np.random.default_rng(0)
    base = "".join(map(chr, rng.integers(97, 123, 300_000)))
    rows = [(1, base), (2, "x" * 50 + base[262_000:262_400] + "y" * 50), (3, "a" * 400)]
    got = repeats.digests(repeats.remove(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.repeated(rows)


def test_near_duplicates(docs, texts, monkeypatch):
    wanted = brute.near_groups(list(texts.items()))
    for room in (near_dups.ROOM, 500):          # the second cuts clusters into blocks
        monkeypatch.setattr(near_dups.confirmed, "__defaults__", (room,))
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.groups(docs, words=4).collect()}
        assert got == wanted


def test_licences(docs, texts):
    for r in licenses.scan(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licences(texts[r.doc_id])
    template = licenses.Template("one <<opt>>two<</opt>> three <<var:1-2>> four")
    for text, end in (("one two three x four", 5), ("one three x y four", 5), ("one three four", None),
                      ("one two two three x four", None), ("one three x y z four", None)):
        assert template.match(licenses.words_of(text), 0) == end


def test_pieces(docs, texts):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    for r in sentencepieces.encode(docs).collect():
        ids = model.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.decoded == model.decode(ids)
        starts, ends = np.frombuffer(r.starts, "<u4"), np.frombuffer(r.ends, "<u4")
        assert (starts[2:-1] == ends[1:-2]).all() and ends[-1] == len(texts[r.doc_id].encode())


def test_compiled_map_matches_the_library():
    import sentencepiece
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = dict(sentencepieces.wire(library.serialized_model_proto()))[3]
    own = sentencepieces.Normalizer(spec)
    for text in ("ｆｕｌｌ ①  wide", "  a\t b ", "ﬁne ㍿ x²", "é ガ", "", "   "):
        normal, source = own.normalize(text.encode())
        assert normal.decode() == library.normalize(text)
        assert len(source) == len(normal) + 1 and (np.diff(source) >= 0).all()


def test_personal_data(docs, texts):
    for r in personal_data.digests(personal_data.find(docs)).collect():
        assert r.base_sha256 == brute.base_digest(texts[r.doc_id])


@pytest.mark.parametrize("text, found", [
    ("mail john (at) example (dot) com now", "email:5:32"),
    ("mail john at example dot com now", "email:5:28"),
    ("jоhn@example.com", "email:0:16"),
    ("call plus one five five five one two three four five six seven", "phone:5:62"),
    ("look at the dot on the map", ""),
    ("one two three at four", "")])
def test_disguises(text, found):
    base = personal_data.identifiers(text)
    extra = [s for s in personal_data.disguised(text, base)]
    assert personal_data.named(extra) == found


@pytest.mark.parametrize("text, found", [
    ("call +1 555 one two three 4567", "phone:5:30"),
    ("10 dot 0 dot zero dot one", "ip:0:25"),
    ("10[.]0[.]0[.]1", "ip:0:14"),
    ("10 (dot) 0 (dot) 0 (dot) 1", "ip:0:26"),
    ("192 dot 168 dot 1 dot 1", "ip:0:23"),
    ("192.168 dot 1 [.] 1", "ip:0:19"),
    ("192 Punkt 168 point 1 point 1", ""),
    ("300 dot 168 dot 1 dot 1", ""),
    ("version 2 dot 5 dot 1", "")])
def test_disguises_do_not_depend_on_other_words(text, found):
    for around in ("", " someone on the phone at one dot (at) @ "):
        whole = text + around
        assert personal_data.named(personal_data.disguised(whole, personal_data.identifiers(whole))) == found
        assert (found == "") == (personal_data.redact_text(whole) == whole)


def test_rules(docs, texts, odd):
    for r in rules.judge(docs).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute.rule_counts(texts[r.doc_id])


def test_outliers_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 5)) * [1, 2, 1, 3, 1]
    x[:40] += 40
    rows = spark.createDataFrame([("v", *map(float, r)) for r in x], "k string, x1 double, x2 double, x3 double, x4 double, x5 double")
    found = rules.estimates(rows, ["k"])
    d = rows.join(found, "k").withColumn("d", rules.distance() / F.col("scale")).orderBy("x1").collect()
    assert sum(r.d > rules.CUT for r in d) == 40
    center = np.array([found.first()[f"m_{i}"] for i in range(5)])
    assert np.abs(center - x[40:].mean(0)).max() < 0.6


def judged_rows(spark, planted, groups):
    """{id: row} of planted [(id, text, lang, source)] among clean texts, ``groups`` {(lang, source): texts}"""
    rng, rows = np.random.default_rng(7), list(planted)
    for (lang, source), n in groups.items():
        rows += [(1000 + len(rows), clean(rng), lang, source) for _ in range(n)]
    found = rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    return {r.doc_id: r for r in found.collect()}


def clean(rng, lines=20):
    return "\n".join(" ".join("".join(map(chr, rng.integers(97, 123, k))) for k in rng.integers(2, 9, 8))
                     for _ in range(lines + rng.integers(0, 9)))


def junk(rng):
    """Texts that pass the base rule: half of the words and nearly all lines repeated; a symbol a word;
    very long words."""
    words = clean(rng).split()
    same = "\n".join([" ".join(words[:3])] * 20 + [" ".join(words[3:70])])
    return [same, " ".join(w + "#" for w in words), " ".join(w * 4 for w in words)]


def test_planted_junk_is_rejected(spark):
    rng = np.random.default_rng(8)
    bad = junk(rng)
    rows = judged_rows(spark, [(i, t, "en", "a") for i, t in enumerate(bad)], {("en", "a"): 200})
    assert not any(rows[i].base_failed or rows[i].kept for i in range(len(bad)))
    good = [r.kept for i, r in rows.items() if i >= 1000]
    assert sum(good) >= 0.99 * len(good)
    # Each share alone can pass the limit.
    assert all((math.log1p(most) / floor) ** 2 > rules.CUT
               for most, floor in zip((100, 100, 50), rules.FLOORS[2:]))


def test_small_groups_are_judged(spark):
    """By their language if it has enough texts, else by the whole table."""
    rng = np.random.default_rng(9)
    bad = junk(rng)
    planted = [(10 * k + i, t, *g) for k, g in enumerate([("en", "tail"), ("fr", "tail"), (None, None)])
               for i, t in enumerate(bad)]
    hot = {("en", "a"): 200, ("en", "tail"): 5, ("fr", "tail"): 4, ("en", "b"): 1, (None, None): 2}
    rows = judged_rows(spark, planted, hot)
    assert all(r.distance is not None for r in rows.values())
    assert not any(rows[p[0]].kept for p in planted)
    good = [r.kept for i, r in rows.items() if i >= 1000]
    assert sum(good) >= 0.98 * len(good)
    small = judged_rows(spark, planted[:1], {("en", "a"): 12, ("fr", "b"): 12})     # fewer than LEAST in all
    assert not small[0].kept and all(r.kept for i, r in small.items() if i)


def test_mix(docs):
    rows = mixing.mix(docs).collect()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    for group in by.values():
        assert abs(sum(r.taken for r in group) - group[0].target) < 1.001
    assert rows == mixing.mix(docs).collect() or sorted(rows) == sorted(mixing.mix(docs).collect())


def test_mixed_slots(docs):
    """The slots of a source, in order, are its stream; every stretch holds the sources in their shares."""
    taken = {r.doc_id: r for r in mixing.mix(docs, block=64).collect()}
    rows = sorted(mixing.mixed(docs, block=64).collect())
    words, by_slot, streams = {}, {}, {}
    for r in rows:
        assert 0 <= r.first_word < r.end_word <= taken[r.doc_id].size
        words[r.doc_id] = words.get(r.doc_id, 0) + r.end_word - r.first_word
        assert r.at == sum(x.end_word - x.first_word for x in by_slot.get(r.slot, []))
        by_slot.setdefault(r.slot, []).append(r)
        streams.setdefault(r.source, []).extend((r.doc_id, i) for i in range(r.first_word, r.end_word))
    assert words == {k: r.taken for k, r in taken.items() if r.taken}
    for source, stream in streams.items():
        ids = sorted((k for k, r in taken.items() if r.source == source and r.size),
                     key=lambda k: hashlib.md5(str(k).encode()).hexdigest())
        once = [(k, i) for k in ids for i in range(taken[k].size)]
        assert stream == (once * 3)[:len(stream)]
    sources = [by_slot[s][0].source for s in sorted(by_slot)]
    assert all(len({r.source for r in part}) == 1 for part in by_slot.values())
    for source in streams:
        share = sources.count(source) / len(sources)
        for n in range(50, len(sources) - 20, 25):
            assert abs(sources[:n].count(source) - share * n) < 8


def test_nearest(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    wanted = brute.nearest([(r.vec_id, r.embedding) for r in rows.collect()])
    got = {}
    for r in nearest.search(rows).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = [len(got[q].keys() & {i for i, _ in w}) / len(w) for q, w in wanted.items()]
    assert np.mean(hits) >= 0.9
    nan = float("nan")
    odd = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]),
                                 (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [1.0, 0.0]), (20, [3.0])],
                                "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest.search(odd).orderBy("rank").collect()] == [
        (0, 1, 1, 1.0), (0, 2, 6, 1.0)]
    assert nearest.search(odd.limit(0)).count() == 0


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = languages.train_and_identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == brute.held_out(r.doc_id) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_quality(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    train = docs.where("doc_id % 4 <> 0")
    model = quality.train(train, quality.ratings_of(labels))
    rows = quality.grade(docs.where("doc_id % 4 = 0"), model).join(labels, "doc_id").collect()
    right = [r.selected == (r.quality == 1 and r.toxic == 0) for r in rows]
    assert np.mean(right) >= 0.85
    none = quality.train(docs, quality.ratings_of(labels.limit(0)))
    assert all(r.selected for r in quality.grade(docs.limit(5), none).collect())


def test_odd_rows_and_empty_tables(spark, odd):
    """Nulls, empty and long texts, repeated rows, clashing names, empty tables."""
    model = quality.train(odd, spark.createDataFrame([(3, 2), (6, 0), (None, 1)], "doc_id long, grade int"))
    calls = [repeats.remove, near_dups.groups, licenses.scan, sentencepieces.encode, personal_data.find,
             rules.judge, mixing.mix, languages.train_and_identify, lambda d: quality.grade(d, model)]
    for call in calls:
        assert call(odd).count() == len(ODD)
        assert call(odd.limit(0)).count() == 0
    groups = {r.doc_id: r for r in near_dups.groups(odd).collect()}
    assert groups[4].component_id == 3 and groups[5].component_id == 3 and groups[None].component_id is None
    assert groups[1].component_id == 1 and groups[1].n_shingles == 0
    removed = {r.doc_id: r for r in repeats.remove(odd).collect()}
    assert removed[3].n_removed == 0 and removed[4].n_removed == len(WORDS) and removed[1].n_bytes == 0
    langs = {r.doc_id: r.lang_pred for r in languages.train_and_identify(odd).collect()}
    assert langs[1] == langs[2] == langs[7] == "und"


def test_suffix_sort():
    from plumbline.llm.suffix_sort import Suffixes
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 500).astype(np.uint8)
    places, raw = np.arange(400), data.tobytes()
    group = np.repeat(np.arange(4), 100)
    order, common = Suffixes(data, 64).ordered(places, np.full(400, 500), group)
    for g in range(4):
        got = [raw[i:i + 64] for i in order[g * 100:(g + 1) * 100]]
        assert got == sorted(raw[i:i + 64] for i in range(g * 100, (g + 1) * 100))
    for a, b, n in zip(order[:-1], order[1:], common[1:]):
        if n >= 0:
            assert raw[a:a + n] == raw[b:b + n] and (n == 64 or raw[a + n:a + n + 1] != raw[b + n:b + n + 1])


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as p
    rows, kept = docs, docs.count()
    for name, stage in p.STAGES[:-1]:
        rows = stage(spark, rows, SMALL)
        assert rows.columns == p.COLUMNS
        if name == "near_duplicates":
            ids = {r.doc_id: r.text for r in rows.collect()}
            assert all(k == c for k, (_, c) in brute.near_groups(list(ids.items()), 5).items())
        if name == "personal_data":
            assert all(not personal_data.identifiers(r.text) for r in rows.limit(50).collect())
    assert 0 < p.pieces(spark, rows, SMALL).count() <= 3 * kept


def test_pipeline_stages_on_all_rows(spark, docs):
    """Private data, mix and pieces against plain versions over all rows, and run() as the stages in turn."""
    import sentencepiece
    import corpus_pipeline as p
    from plumbline.llm.common import stored
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    good = stored(p.distinct_documents(spark, p.good_documents(spark, docs, SMALL), SMALL))
    clean_rows = stored(p.private_data_out(spark, good, SMALL))
    before = {r.doc_id: r.text for r in good.collect()}
    after = {r.doc_id: r for r in clean_rows.collect()}
    assert before.keys() == after.keys()
    for k, text in before.items():
        spans, out, at = brute.personal(text), "", 0
        for start, kind, end in spans:
            if start >= at:
                out += text[at:start] + f"[{('email', 'ip', 'card', 'phone')[kind]}]"
            at = max(at, end)
        assert after[k].text == out + text[at:] and after[k].n_chars == len(after[k].text)
    mixed = stored(p.mixed_sources(spark, clean_rows, SMALL))
    times = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        assert r == after[r.doc_id]
    rounds = {r.doc_id: -(-r.taken // r.size) for r in mixing.mix(clean_rows).collect() if r.taken}
    assert times == rounds
    got = sorted((r.doc_id, r.ids_sha256) for r in p.run(spark, SMALL).collect())
    ids = {k: model.encode(r.text, add_bos=True, add_eos=True) for k, r in after.items()}
    assert got == sorted((k, hashlib.sha256(struct.pack(f"<{len(ids[k])}I", *ids[k])).hexdigest())
                         for k, n in times.items() for _ in range(n))
