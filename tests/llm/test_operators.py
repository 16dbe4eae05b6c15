"""Corpus operators against brute force, on one fixture of awkward rows."""

import hashlib
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plinth.llm import golomb, language_id, licenses, packing, quality, sharding
from plinth.llm.common import RunHash, SpanHash, word_spans
from plinth.llm.decontamination import contamination
from plinth.llm.exact_dedup import exact_duplicates
from plinth.llm.licenses import licence_scan
from plinth.llm.line_dedup import build_index, find_slots, without_repeated_lines
from plinth.llm.near_dedup import near_duplicates
from plinth.llm.packing import packed_sequences
from plinth.llm.sharding import balanced_shards
from plinth.llm.substring_dedup import without_repeated_passages
from plinth.llm.tokens import Encoder, encoder, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, size int, h1 double, Bands string"
PROSE = [f"w{i % 97}x{(i * i) % 89}" for i in range(900)]


def rows():
    base = " ".join(PROSE[:300])
    near = " ".join(PROSE[:150] + ["other"] + PROSE[151:300])
    far = " ".join(PROSE[:100] + PROSE[600:800])
    shared = "This line is found in many documents."
    texts = {
        1: base, 2: base, 3: near, 4: far, 5: None, 6: "", 7: " \t\n ", 8: "one", 9: "one two", 10: "one two",
        11: f"{shared}\nalpha beta\n{shared}", 12: f"  {shared.upper()}\t\nshort\nshort", 13: "short", 14: "É é " * 40, 15: "Licensed under the MIT License. CC BY-NC; Apache License, Version 2.0",
        16: " ".join(PROSE * 30), 17: "a " * 500, 18: "Ünïcödé wörds\x1chere now", 19: "\n\n", 20: "one\ttwo", 21: " one two", 22: "bench mark " + " ".join(f"b{i}" for i in range(20)),
    }
    out = [(i, t, "en" if i % 3 else None, None, 0, "c", 1, 0.5, "b") for i, t in texts.items()]
    return out + [(1, base, "en", "again", 0, None, None, None, None), (None, "lost", None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def kept_rows():
    return sorted((i, t or "") for i, t, *_ in rows() if i is not None)


def table(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def blank_words(text):
    return text.encode().split()


def test_exact_duplicates(docs, empty):
    groups = defaultdict(list)
    for i, t in kept_rows():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    want = sorted((i, min(g), len(g), i == min(g), hashlib.sha256(body.encode()).hexdigest()) for body, g in groups.items() for i in g)
    assert table(exact_duplicates(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact_duplicates(empty).count() == 0


def line_truth():
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in kept_rows():
        for line in t.split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, t in kept_rows():
        lines = t.split("\n")
        left = [x for x in lines if not (len(key(x)) >= 10 and i > min(holders[key(x)]))]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out)


def test_line_dedup(docs, empty):
    out = without_repeated_lines(docs)
    assert table(out.withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", "text", "n_lines", "n_dropped") == line_truth()
    assert without_repeated_lines(empty).count() == 0


def near_truth(k, percent):
    sets = {}
    for i, t in kept_rows():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return sorted((i, len(sets[i]), label[i], label[i] == i) for i, _ in kept_rows())


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, k):
    assert table(near_duplicates(docs, k), "doc_id", "n_shingles", "component_id", "kept") == near_truth(k, 80)


def test_near_duplicates_empty(empty):
    assert near_duplicates(empty).count() == 0


def test_near_duplicates_through_prefixes(spark):
    """A group where no hub sees all: copies of copies, each one step further."""
    words = [f"t{i}" for i in range(200)]
    texts = []
    for step in range(12):
        texts.append((step, " ".join(words)))
        words = words[:]
        for j in range(4):
            words[(step * 4 + j) * 4 % 200] = f"n{step}_{j}"
    df = spark.createDataFrame(texts, "doc_id long, text string")
    sets = {}
    for i, t in texts:
        w = t.split()
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {r.doc_id: r.component_id for r in near_duplicates(df, 4).collect()} == label


@pytest.mark.parametrize("worth", [1 << 12, 1])
def test_near_duplicates_in_few_files(spark, docs, monkeypatch, worth):
    """Scratch tables have the files that their rows are worth, not one for each shuffle partition; results stay."""
    from plinth import session
    from plinth.llm import near_dedup

    for name in ("FILE_DOCS", "FILE_SHINGLES", "FILE_PAIRS"):
        monkeypatch.setattr(near_dedup, name, worth)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        out = near_duplicates(docs, 4)
        assert table(out, "doc_id", "n_shingles", "component_id", "kept") == near_truth(4, 80)
        made = Path(session._made[-1][1].removeprefix("file://"))
        files = {p.name: len(list(p.glob("part-*"))) for p in made.iterdir() if p.name != "digests"}
        assert files and (max(files.values()) == 1) == (worth > 1), files
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_components_both_ways(spark):
    from plinth.llm.common import Scratch, components

    draw = np.random.default_rng(9)
    pairs = [(int(a), int(b)) for a, b in draw.integers(0, 400, (260, 2))] + [(900 + i, 901 + i) for i in range(30)]
    edges = spark.createDataFrame(pairs, "u long, v long")
    one, many = ({r.node: r.component for r in components(edges, Scratch(spark, "cc"), "c", limit).collect()} for limit in (1 << 20, 0))
    assert one == many and one[930] == 900


def passage_truth(window=20):
    texts = dict(kept_rows())
    first = {}
    for i in sorted(texts):
        w = blank_words(texts[i])
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), (i, j))
    out = []
    for i, t in kept_rows():
        w = blank_words(t)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] != (i, j):
                gone[j : j + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_passages(docs, empty):
    assert table(without_repeated_passages(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == passage_truth()
    assert without_repeated_passages(empty).count() == 0


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


BENCH = [(10, "bench mark " + " ".join(f"b{i}" for i in range(20))), (11, "one two"), (12, None), (13, "É"), (14, " ".join(PROSE[20:40])), (14, " ".join(PROSE[20:40])), (None, "one")]


@pytest.mark.parametrize("limit", [32 << 20, -1])
def test_contamination(spark, docs, empty, limit):
    windows = defaultdict(set)
    for i, t in BENCH:
        w = words_of(t)
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if w and i is not None else 0):
            windows[tuple(w[j : j + n])].add(str(i))
    want = []
    for i, t in kept_rows():
        w = words_of(t)
        hit, items = [0] * len(w), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if found := windows.get(tuple(w[j : j + n])):
                    items |= found
                    hit[j : j + n] = [1] * n
        want.append((i, len(w), sum(hit), sorted(items), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = table(contamination(docs, bench, limit), "doc_id", "n_words", "n_hit", "items", "contaminated")
    assert got == sorted(want)
    assert contamination(empty, bench, limit).count() == 0
    assert contamination(docs, bench.limit(0), limit).where("contaminated").count() == 0


def test_contamination_judges_rows_of_one_id_apart(spark, docs):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    item = BENCH[0][1]
    more = spark.createDataFrame([(1, item), (70, item), (70, "a clean text"), (70, "a clean text"), (70, None)], "doc_id long, text string")
    source, columns = docs.select("doc_id", "text").unionByName(more), ("doc_id", "n_words", "n_hit", "items", "contaminated")
    near, far = (table(contamination(source, bench, limit), *columns) for limit in (32 << 20, -1))
    assert near == far and len(far) == len(kept_rows()) + 5
    assert [x[1:3] + x[4:] for x in far if x[0] == 70] == [(0, 0, False), (3, 0, False), (3, 0, False), (22, 22, True)]


def test_licence_scan(docs, empty):
    got = {r.doc_id: r for r in licence_scan(docs).collect()}
    for i, t in kept_rows():
        w = words_of(t)
        starts = sorted(j for p in ("under the mit license", "apache license version 2", "cc by nc") for j in range(len(w)) if w[j : j + len(p.split())] == p.split())
        assert got[i].base == starts and got[i].n_words == len(w) and 0 <= got[i].score <= 1
    assert got[15].base_labels == "apache-2,cc-by-nc,mit" and got[8].labels == "" and got[8].score == 0
    assert licence_scan(empty).count() == 0


def test_licence_scan_any_word_changed(spark):
    texts, want = [], {}
    for t in licenses.MORE:
        parts, key = t.text.split(), t.key.split() or t.text.split()
        offset = next(i for i in range(len(parts)) if parts[i : i + len(key)] == key)
        for at in range(len(parts)):
            n = len(texts)
            texts.append((n, " ".join(["before", *parts[:at], "changed", *parts[at + 1 :], "after"])))
            kept = not offset <= at < offset + len(key) and len(parts) - 1 >= t.share * len(parts)
            want[n] = (t.label, kept, (len(parts) - 1) / len(parts))
    got = {r.doc_id: r for r in licences_of(spark, texts)}
    for n, (label, kept, share) in want.items():
        places = [(p["label"], p["start"], p["share"]) for p in got[n].places]
        assert ((label, 1, share) in places) == kept, texts[n]
    # The rarest words of the opening stand nowhere else, so the corpus alone would post one of them.
    short = "Permission is hereby granted, free of charge, to any person obtaining a copy of this program"
    assert [r.labels for r in licences_of(spark, [(1, short), (2, "free software"), (3, None)])] == ["mit", "", ""]


def licences_of(spark, texts):
    return licence_scan(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id").collect()


def test_packing(docs, empty):
    out = packed_sequences(docs).toPandas()
    encode = encoder(vocabulary(None)).encode
    total = 0
    for i, t in dict(kept_rows()).items():
        ids = encode([t.encode()])[0] + b"\x01\0\0\0"
        mine = out[out.doc_id == i].sort_values("piece").drop_duplicates("piece")
        assert mine.start.tolist() == list(range(0, len(ids) // 4, 4096))
        assert mine.length.tolist() == [len(ids[4 * s : 4 * s + 4 * 4096]) // 4 for s in mine.start]
        assert mine.ids_crc32.tolist() == [zlib.crc32(ids[4 * s : 4 * s + 4 * 4096]) for s in mine.start]
    total = out.length.sum()
    by = out.sort_values("offset").groupby("sequence_id")
    assert all((g.length.cumsum() - g.length == g.offset).all() and g.length.sum() <= 4096 for _, g in by)
    assert out.sequence_id.nunique() <= -(-total // 4096) + 1
    assert packed_sequences(empty).count() == 0


def test_packing_plan_is_tight():
    draw = np.random.default_rng(3)
    histogram = np.bincount(np.minimum(4096, draw.lognormal(6.5, 1, 5000).astype(int) + 1), minlength=4097)
    segments = packing.plan(histogram, 4096)
    assert (np.bincount(segments[:, 0], segments[:, 2], 4097) == histogram).all()
    used = defaultdict(int)
    for length, _, count, first, _ in segments.tolist():
        for s in range(first, first + count):
            used[s] += length
    assert max(used.values()) <= 4096 and len(used) <= -(-int((histogram * np.arange(4097)).sum()) // 4096) * 1.01 + 1


def test_token_cache_equals_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary(None))
    texts = ["It's 'tis we'll 12ab ÀÉ İx ﬁn «q» éx ́ <|endoftext|> a<|startoftext|>b 你好 ΑΣ ª\x1cb ×÷ 'S ''ve x'RE", "", " \n ", "don't,'s!"]
    for text, ids in zip(texts, encoder(vocabulary(None)).encode([t.encode() for t in texts]), strict=True):
        assert whole.encode(text, add_special_tokens=False).ids == np.frombuffer(ids, "<u4").tolist()


def test_token_cache_on_letters_whose_lower_case_lies_elsewhere():
    """Such letters (U+0181, U+023A) once stopped the whole job; random texts over marks and letters, both generations."""
    from tokenizers import Tokenizer

    whole, cache = Tokenizer.from_file(vocabulary(None)), Encoder(vocabulary(None))
    draw = np.random.default_rng(3)
    signs = [*map(chr, range(0x20, 0x250)), *"'" * 60, *"strevlmd" * 8, *" " * 30, "\x1c", "\x85", "\n", "\u201c", "\u4f60", "<|"]
    texts = ["\u023a\u0181a \u0181ara"]
    texts += ["".join(draw.choice(signs, n)) for n in draw.integers(0, 60, 2000)]
    texts += ["".join(draw.choice(list("abz\u00e9''srevldmt05 .-\n"), n)) for n in draw.integers(0, 60, 2000)]
    for at in range(0, len(texts), 200):
        if at % 600 == 0:
            cache.former, cache.pieces = cache.pieces, {}
        part = texts[at : at + 200]
        for text, ids in zip(part, cache.encode([t.encode() for t in part]), strict=True):
            assert whole.encode(text, add_special_tokens=False).ids == np.frombuffer(ids, "<u4").tolist()


def test_token_caches_are_given_back():
    """Workers outlive their stage; what they kept added up with the memory of the stages after it."""
    cache = Encoder(vocabulary(None))
    before = cache.encode([b"some words", "some \u4f60 words".encode()])
    assert cache.pieces and cache.chunks
    cache.rest()
    assert not cache.pieces and not cache.former and not cache.chunks and cache.encode([b"some words", "some \u4f60 words".encode()]) == before


def test_shards_are_near_equal(spark):
    """The law ``bytes``: with groups that are small against a shard, sizes differ by less than a small group."""
    draw = np.random.default_rng(8)
    texts = [(i, "x" * int(n)) for i, n in enumerate(draw.integers(1, 900, 3000))] + [(5000 + i, "y" * 300) for i in range(1000)]
    out = balanced_shards(spark.createDataFrame(texts, "doc_id long, text string"), 8).toPandas()
    loads = out.groupby("shard")["size"].sum()
    group = {t: sum(len(x) + 1 for _, x in texts if x == t) for _, t in texts}
    mean = sum(group.values()) / 8
    biggest = max(group.values())
    # The one group that outweighs the mean share is a shard of its own; the others share the rest evenly.
    assert loads.max() == max(biggest, loads.max()) and (biggest <= mean or loads.drop(loads.idxmax()).max() - loads.drop(loads.idxmax()).min() <= 1000)
    small = balanced_shards(spark.createDataFrame([(i, "x" * int(n)) for i, n in enumerate(draw.permutation(3000) + 1)], "doc_id long, text string"), 8).toPandas()
    loads = small.groupby("shard")["size"].sum()
    assert len(loads) == 8 and loads.max() - loads.min() <= 8
    assert set(out.law) == {"bytes"} and out.grown_shard.isna().all()


def test_sharding(docs, empty):
    out = balanced_shards(docs, 4).toPandas()
    assert len(out) == len(kept_rows())
    text = dict(kept_rows())
    where = defaultdict(set)
    for r in out.itertuples():
        where[text[r.doc_id]].add(r.shard)
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert balanced_shards(empty).count() == 0


def test_differencing_balances():
    weights = np.random.default_rng(1).integers(1, 10_000, 4000)
    vectors = np.zeros((len(weights), 8), np.int64)
    vectors[:, 0] = weights
    sums, went = sharding.difference(vectors)
    assert (np.bincount(went[:, 0], weights, 8) == sums).all() and sums.max() - sums.min() <= 2


def test_language(spark, docs, empty):
    talk = {"aa": "bada gado bado daga goda ", "zz": "xiwe qiwe wexi kiqe xeki "}
    teach = spark.createDataFrame([(i, talk[k] * (1 + i % 3), k) for i, k in enumerate(["aa", "zz"] * 10)], "doc_id long, text string, lang string")
    profiles = language_id.learn(teach)
    asked = spark.createDataFrame([(1, "gado bado"), (2, "qiwe kiqe"), (3, None), (4, "12 %"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(asked, profiles).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["aa", "zz", "und", "und", "und"] and got[3][1] == 0
    assert all(0 <= s <= 1 for _, s in got.values())
    assert table(language_id.accepted(asked, profiles), "doc_id") == [(1,), (2,)]
    assert language_id.identify(docs, language_id.learn(docs)).count() == len(kept_rows())
    assert {r.lang_pred for r in language_id.identify(asked, language_id.learn(empty)).collect()} == {"und"}


def grams_truth(text):
    """N-grams of a text with their counts, by reading it letter by letter."""
    table = language_id._letters()
    code = [0, *(int(table[ord(c)]) for c in text), 0]
    counts = defaultdict(int)
    for i in range(1, len(code)):
        if code[i]:
            counts[(1 << 36) | code[i]] += 1
            counts[(3 << 36) | code[i - 1] << 24 | code[i] << 12 | code[i + 1]] += 1
        if code[i] or code[i - 1]:
            counts[(2 << 36) | code[i - 1] << 12 | code[i]] += 1
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))


def test_language_by_recounted_distances(monkeypatch):
    texts = ["bada gado", "", "x", "Ünïcödé wörds, 12 more; wörds", "bada " * 60 + "daba", "数 字 abc " * 9, "..!"]
    for window in (1 << 17, 7):  # windows of any size count alike
        monkeypatch.setattr(language_id, "_POINTS", window)
        number, code, count = language_id.ranked_grams(texts)
        for i, t in enumerate(texts):
            assert list(zip(code[number == i].tolist(), count[number == i].tolist(), strict=True)) == grams_truth(t)
    taught = {"aa": "bada gado daba goda " * 3, "bb": "wörds more cödé abc", "cc": "bada gado daba goda " * 3}
    ranks = {k: {c: i for i, (c, _) in enumerate(grams_truth(t)[: language_id.PROFILE])} for k, t in taught.items()}
    profiles = language_id.Profiles([(k, c, i) for k, r in ranks.items() for c, i in r.items()])
    names, scores = profiles.judge(texts)
    for t, name, score in zip(texts, names, scores.tolist(), strict=True):
        own = grams_truth(t)[: language_id.PROFILE]
        if not own:
            assert (name, score) == ("und", 0)
            continue
        away = {k: sum(abs(r[c] - i) if c in r else language_id.PROFILE for i, (c, _) in enumerate(own)) for k, r in ranks.items()}
        best = min(sorted(away), key=away.get)  # ties: the first name
        assert name == best and abs(score - (1 - away[best] / (language_id.PROFILE * len(own)))) < 1e-12


def test_quality_score_recomputed():
    """A score by plain loops over passages, attention and the scorer."""
    draw = np.random.default_rng(6)
    texts = ["one two three " * 40, "", "Short.", "a b c d " * 25 + "END"]
    figures, edges = quality.passages(pa.array(texts, pa.large_string()))
    assert np.diff(edges).tolist() == [3, 1, 1, 3]
    model = quality.fit(figures, edges, np.array([1, 0, 0, 1], np.float32), rounds=5)
    w = model.weights
    got = model.score(figures, edges)
    for i in range(len(texts)):
        coded, energy = [], []
        for row in figures[edges[i] : edges[i + 1]]:
            h = np.tanh(((row - model.mean) / model.spread) @ w["W"] + w["b"])
            coded.append(h)
            energy.append(float((np.tanh(h @ w["V"]) * (1 / (1 + np.exp(-(h @ w["U"]))))) @ w["w"]))
        weight = np.exp(np.array(energy) - max(energy))
        z = sum(a * h for a, h in zip(weight / weight.sum(), coded, strict=True))
        assert abs(got[i] - 1 / (1 + np.exp(-(z @ w["c"] + w["c0"][0])))) < 1e-5
    long = pa.record_batch([pa.array([1]), pa.array([" ".join(str(x) for x in draw.integers(0, 9, 40 * 90))])], ["doc_id", "text"])
    bag = next(quality._bags(iter([long]), 32)).column(1)[0].as_py()
    assert len(bag) == 32 * quality.WIDTH * 4


def test_quality(spark, empty):
    good, bad = "some plain words that run on and on ", "BUY!! NOW!! $$$ %%% "
    texts = spark.createDataFrame([(i, (good if i % 2 else bad) * (1 + i % 5)) for i in range(60)] + [(98, None), (99, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (500, 1)], "doc_id long, quality int")
    model = quality.learn(texts, labels)
    got = {r.doc_id: r.score for r in quality.score(texts, model).collect()}
    assert len(got) == 62 and all((got[i] >= 0.7) == bool(i % 2) for i in range(60)) and all(0 <= s <= 1 for s in got.values())
    assert quality.learn(texts, labels.limit(0)) is None
    assert {r.score for r in quality.score(texts, None).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0


def test_quality_gradients():
    draw = np.random.default_rng(0)
    figures = draw.random((9, quality.WIDTH)).astype(np.float32)
    edges, y = np.array([0, 2, 5, 9]), np.array([1.0, 0.0, 1.0])
    model = quality.fit(figures, edges, y.astype(np.float32), rounds=3)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    loss = lambda: -np.mean(y * np.log(model.forward(figures, edges)["p"]) + (1 - y) * np.log(1 - model.forward(figures, edges)["p"]))
    grads = model.gradients(figures, edges, y)
    for name, at in (("W", (3, 5)), ("V", (2, 1)), ("U", (4, 2)), ("w", (1,)), ("c", (2,)), ("c0", (0,)), ("b", (1,))):
        kept = model.weights[name][at]
        model.weights[name][at] = kept + 1e-5
        up = loss()
        model.weights[name][at] = kept - 1e-5
        slope = (up - loss()) / 2e-5
        model.weights[name][at] = kept
        assert abs(slope - grads[name][at]) < 1e-6


def test_golomb_round_trip():
    draw = np.random.default_rng(2)
    for n, top in ((0, 10), (1, 1), (50, 60), (1000, 1 << 40)):
        values = np.unique(draw.integers(0, top, n))
        assert (golomb.decode(golomb.encode(values)) == values).all()


def test_minimal_perfect_hash():
    keys = np.random.default_rng(4).integers(0, 1 << 63, (5000, 2)).astype(np.uint64)
    keys[100:200, 0] = keys[:100, 0]  # equal first halves are still two keys
    sizes, bits, slots = build_index(keys)
    assert sorted(slots) == list(range(len(keys))) and (find_slots(keys, sizes, bits) == slots).all()


def test_span_hash_sees_every_byte():
    data = np.frombuffer(b"ab ba aab ab", np.uint8)
    starts, ends, first = word_spans(data, np.array([0, 6, 12]))
    h = SpanHash(1)(data, starts, ends)
    assert first.tolist() == [0, 2, 4] and h[0] == h[3] and len(set(h.tolist())) == 3


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


def test_structured_texts_do_not_collide(spark):
    """Two texts on which every polynomial hash modulo a power of two collides: unlike lines, words, passages, sets."""
    one, two = thue_morse(1024, "ab"), thue_morse(1024, "ba")
    data = np.frombuffer((one + two).encode(), np.uint8)
    a, b = SpanHash(1)(data, np.array([0, 1024]), np.array([1024, 2048])).tolist()
    assert a != b and len(set(SpanHash(1)(data[:400], np.arange(0, 400, 2), np.arange(2, 402, 2)).tolist())) == 2
    run = RunHash(1)
    values = np.array([1 if c == "a" else 2 for c in one + two], np.uint64)
    found = run(values, 1024)
    assert found[0] != found[1024]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert table(without_repeated_lines(frame([(1, one), (2, two)])), "doc_id", "n_dropped") == [(1, 0), (2, 0)]
    same = " ".join(f"s{i}" for i in range(19))
    got = table(without_repeated_passages(frame([(1, f"{same} {one}"), (2, f"{same} {two}"), (3, f"{same} {two}")])), "doc_id", "n_removed")
    assert got == [(1, 0), (2, 0), (3, 20)]
    got = table(near_duplicates(frame([(1, one), (2, two), (3, two), (4, f"{same} {one}"), (5, f"{same} {two}")]), 4), "doc_id", "component_id")
    assert got == [(1, 1), (2, 2), (3, 2), (4, 4), (5, 4)]


def test_repeated_ids_with_unlike_texts(spark):
    """Rows that share an id are one document: it never repeats itself, and what another one took goes from each."""
    line, passage = "a line that is long enough", " ".join(f"p{i}" for i in range(30))
    rows = [(7, line), (7, f"{line}\nmore"), (9, f"{line}\nnine"), (9, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert table(without_repeated_lines(docs), "doc_id", "text", "n_dropped") == [(7, line, 0), (7, f"{line}\nmore", 0), (9, "", 1), (9, "nine", 1)]
    rows = [(7, passage), (7, f"other {passage}"), (9, f"nine {passage} end"), (9, passage)]
    got = table(without_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_words", "n_removed")
    assert [x for x in got if x[0] == 9] == [(9, 30, 30), (9, 32, 30)] and len(got) == 4


def test_long_items_and_places(spark):
    """An item much longer than its windows, with runs that repeat, against brute force on both paths."""
    draw = np.random.default_rng(12)
    item = [f"v{n}" for n in draw.integers(0, 6, 900)] + ["z"] * 60
    texts = [(1, " ".join(item[100:140] + ["gap"] + item[880:])), (2, " ".join(["z"] * 200)), (3, " ".join(f"v{n}" for n in draw.integers(0, 6, 3000))), (4, " ".join(item))]
    windows = {tuple(item[i : i + 13]) for i in range(len(item) - 12)}
    want = []
    for i, t in texts:
        w, hit = t.split(), np.zeros(len(t.split()), bool)
        for j in range(len(w) - 12):
            if tuple(w[j : j + 13]) in windows:
                hit[j : j + 13] = True
        want.append((i, len(w), int(hit.sum())))
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for limit in (32 << 20, -1):
        assert table(contamination(docs, bench, limit), "doc_id", "n_words", "n_hit") == want
