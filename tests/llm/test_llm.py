"""Small brute-force, round-trip and held-out tests of the training-data operators, with odd rows."""

import collections
import glob
import math
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glossweave.llm import ann, langid, merge_dropout, neardup, packing, quality, sharding, token_files, tokens
from glossweave.llm.components import connected_components

SF = "/root/testdata/sf0.001"
BASE = "the quick brown fox jumps over the lazy dog and then it runs through the green wood to find some rest by the old mill before dark falls again"
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE + " now", "en", "b"), (4, None, None, None), (5, "", "en", "b"), (6, " \n\t ", "en", "b"),
    (7, "one two", "de", "c"), (8, "One  TWO", "de", "c"), (9, "x" * 5000 + " é ß it's 12,5\n\nA  b", "fr", "c"), (None, "no id here", "en", "c"),
    (11, " ".join(f"w{i}" for i in range(3000)), "es", "c"), (11, " ".join(f"w{i}" for i in range(3000)), "es", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, 1) for r in ROWS], "doc_id long, text string, lang string, source string, rank int, part int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def ids_of(name, text):
    return Tokenizer.from_file(P.path(name)).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_encoder_equals_library(name, kind):
    e = tokens.Encoder(P.path(name), kind)
    for text in ["", "  a  b", "it's IT'S\n\n x  ", "É ÉÀ İ ß ªº x́ a\x0bb", "日本 語. x²½", "a b  c", "<|endoftext|> x", "x <|endoftext|> y", "x <|ENDOFTEXT|> y <|startoftext|>", "<|endo ftext|>  <|", "a<|endoftext|>b  c\n", *[r[1] or "" for r in ROWS]]:
        assert np.frombuffer(e.encode(text), "<u4").tolist() == ids_of(name, text)


def test_token_files(docs, empty):
    path = P.path("word_bpe_49k.json")
    got = sorted(map(tuple, token_files.token_files(docs, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted([r[0] for r in ROWS], key=lambda x: (x is not None, x or 0))
    at = 0
    texts = collections.defaultdict(list)
    for r in ROWS:
        texts[r[0]].append(r[1])
    for doc, start, n, crc in got:
        ids = np.array([*ids_of("word_bpe_49k.json", texts[doc][0]), 1], "<u4")
        assert (start, n, crc) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += n
    assert token_files.token_files(empty, path).count() == 0


def test_token_files_are_pruned(spark, tmp_path):
    """The files hold stripes, row indexes and a Bloom filter on doc_id, and a filter on doc_id reads few rows."""
    rng, path = np.random.default_rng(3), str(tmp_path / "files")
    ids = rng.permutation(40_000)[:20_000]
    rows = [(int(2 * i), " ".join(f"w{int(k)}" for k in rng.integers(0, 999, 20))) for i in ids]
    spark.conf.set("spark.sql.orc.filterPushdown", "true")
    token_files.encode_to_orc(spark.createDataFrame(rows, "doc_id long, text string"), path, P.path("word_bpe_49k.json"))
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    bloom, stripes, total, last = 0, 0, 0, None
    for name in sorted(glob.glob(f"{path}/*.orc")):
        at = jvm.org.apache.hadoop.fs.Path(name)
        reader = jvm.org.apache.orc.OrcFile.createReader(at, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        n = reader.getStripes().size()
        stripes, total = stripes + n, total + reader.getNumberOfRows()
        assert reader.getRowIndexStride() == 1000
        records = reader.rows()
        for i in range(n):
            streams = records.readStripeFooter(reader.getStripes().get(i)).getStreamsList()
            bloom += sum("BLOOM" in streams.get(j).getKind().toString() for j in range(streams.size()))
        own = [r.doc_id for r in spark.read.schema(token_files.SCHEMA).orc(name).select("doc_id").collect()]
        assert own == sorted(own) and (last is None or not own or own[0] > last)
        last = own[-1] if own else last
    assert total == len(rows) and stripes > 0 and bloom >= stripes
    files = token_files.read_orc(spark, path)
    plan = files.filter("doc_id = 12")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "EqualTo(doc_id,12)" in plan


def brute_components(rows, percent):
    sets = {}
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    linked = [(a, b) for a in sets for b in sets if a < b and (both := len(sets[a] & sets[b])) and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)]
    label, was = {k: k for k in sets}, None
    while label != was:
        was = dict(label)
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    return {k: (len(sets[k]), label[k]) for k in sets}


def test_near_duplicates_odd_rows(docs, empty):
    rows = [r for r in ROWS if r[0] is not None]
    got = neardup.near_duplicates(docs, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute_components(rows, 85)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got) and len(got) == len(ROWS)
    assert neardup.near_duplicates(empty, 85).count() == 0


def test_near_duplicates_sf(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(d, 85).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in d.collect()], 85)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (7, 8), (5, 5), (3, 4)], "u long, v long")
    assert {(r.node, r.component) for r in connected_components(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7), (9, 7)}


def test_merge_dropout(docs):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), merge_dropout.Pieces(path)
    for text in ["", " a  b", "日本 ▁x▁ ▁▁", "http://a.b/c?d 12,3\n\n", *[r[1] or "" for r in ROWS]]:
        assert m.decode(m.encode(text, "k", 0.5, 3)) == text
        if "▁" not in text:
            assert np.frombuffer(merge_dropout.Pieces(path).encode(text, "k", 0.0), "<u4").tolist() == sp.encode(text)
    assert all(r.lossless for r in merge_dropout.round_trip(docs, path).collect())


def test_language_id(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_id(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    odd = langid.language_id(docs).collect()
    assert len(odd) == len(ROWS) and all(r.lang_pred == "und" for r in odd if r.doc_id in (4, 5, 6)) and all(0 <= r.score <= 1 for r in odd)
    assert langid.language_id(empty).count() == 0


def plain_probabilities(net, raw):
    """The network position by position, with plain loops, in windows of SPAN bytes."""
    sigmoid, total = (lambda x: 1 / (1 + np.exp(-x))), np.zeros(net.k)
    for lo in range(0, len(raw), langid.SPAN):
        part = raw[lo : lo + langid.SPAN]
        part = part + bytes(-len(part) % langid.SPAN)
        states = {}
        for d, order in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
            s, h = np.zeros(net.h), net.h
            for t in order:
                g, a = net.p[f"W{d}"][part[t]] + net.p[f"b{d}"], s @ net.p[f"U{d}"]
                z, r = sigmoid(g[:h] + a[:h]), sigmoid(g[h : 2 * h] + a[h : 2 * h])
                s = z * s + (1 - z) * np.tanh(g[2 * h :] + r * a[2 * h :])
                states[d, t] = s
        for t in range(min(langid.SPAN, len(raw) - lo)):
            o = np.concatenate([states["f", t], states["b", t]]) @ net.p["V"] + net.p["c"]
            total += o - np.log(np.exp(o - o.max()).sum()) - o.max()
    p = np.exp(total / langid.POOL - (total / langid.POOL).max())
    return p / p.sum()


def test_language_id_position_by_position():
    net, texts = langid.Network(3, seed=4), [b"a", "é ß long enough to fill more than one window. ".encode() * 9, b"x" * 160, b"y" * 161]
    for raw, got in zip(texts, langid.predict(net, texts), strict=True):
        assert np.allclose(got, plain_probabilities(net, raw), atol=1e-4)


def test_language_id_letters_labels_and_columns(spark):
    words = {f"l{i:03d}": " ".join(chr(97 + (i + j) % 26) * 3 for j in range(12)) for i in range(90)}
    rows = [(i, words[k], k, 0.5, "x") for i, k in enumerate(list(words) * 4)] + [(900 + i, t, None, 0.1, "y") for i, t in enumerate(["²", "½ ①", "12 _ 3", "日", "é", "ª"])]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    got = {r.doc_id: r.lang_pred for r in langid.language_id(d).collect()}
    assert [got[900 + i] == "und" for i in range(6)] == [True, True, True, False, False, False]
    out = langid.identify(d, d.filter(~langid.held_out()))
    assert out.columns == [*d.columns, "_lang_pred", "_score"] and {r.score for r in out.collect()} == {0.5, 0.1}
    assert {r.lang for r in langid.sample(d).collect()} == set(words)


def test_language_id_gradients():
    net, rng = langid.Network(3), np.random.default_rng(0)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x, y, mask = rng.integers(0, 256, (5, 4)), np.array([0, 1, 2, 1]), np.ones((5, 4))
    _, g = net.gradients(x, y, mask)
    for k in ("Uf", "Ub", "V", "bf"):
        i = tuple(rng.integers(0, s) for s in net.p[k].shape)
        was = net.p[k][i]
        net.p[k][i] = was + 1e-2
        up = net.gradients(x, y, mask)[0]
        net.p[k][i] = was - 1e-2
        down = net.gradients(x, y, mask)[0]
        net.p[k][i] = was
        assert abs((up - down) / 2e-2 - g[k][i]) < 1e-3


def plain_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    cover = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(cover), len(lines)


def test_quality_counts(spark, docs, empty):
    odd = ["a\nb\na\n \n \na b", "#x $ % & | < > *#", "x " * 30, "a b c d e f g h i a b c d e f g h", "é\u00a0ß\u2003x", "\x0b\x0c a \r\n b", "a " * 100_000]
    rows = [(r[0], r[1]) for r in ROWS] + [(100 + i, t) for i, t in enumerate(odd)]
    got = {r.doc_id: r for r in quality.measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, text in rows:
        r, want = got[doc], plain_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").withColumn("n_words", F.lit(1)).withColumn("stratum", F.lit("x"))
    assert quality.quality_rules(docs, labels).filter("kept").count() == 5
    assert quality.quality_rules(empty, labels).count() == 0 and quality.quality_rules(docs, labels.limit(0)).count() == len(ROWS)


def test_quality_cutoffs(spark):
    """Rungs stand while the exact test holds; the first that fails ends a ladder, and few labels prove none."""
    rng = np.random.default_rng(8)
    rows = [(i, "plain words " * 20 + "#" * int(k)) for i, k in enumerate(rng.poisson(0.3, 3000))] + [(5000 + i, "x " * 300) for i in range(50)]
    measured = spark.createDataFrame([(d, *plain_counts(t), False) for d, t in rows], "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, base_failed boolean")
    labels = spark.createDataFrame([(d, 1) for d, _ in rows], "doc_id long, quality int")
    got = {r.stratum: r for r in quality.choose_cutoffs(measured, labels).collect()}
    held, p, level = [t for d, t in rows if d < 5000], quality.RISK / 3, quality.DELTA / 15
    cut = None
    for c in quality.LADDERS["symbol_pct"]:
        k = sum(100 * t.count("#") / plain_counts(t)[1] > c for t in held)
        if k >= len(held) * p or sum(math.comb(len(held), i) * p**i * (1 - p) ** (len(held) - i) for i in range(k + 1)) > level:
            break
        cut = c
    assert got[1].symbol_pct_cutoff == cut and 0 < cut < 5
    assert got[3].symbol_pct_cutoff is None and got[3].dup_line_pct_cutoff is None


def test_binomial(spark):
    cases = [(20, 0, 0.02), (300, 2, 0.02), (1000, 12, 0.02), (7, 0, 0.5), (5000, 70, 0.02)]
    df = spark.createDataFrame(cases, "n long, k long, p double")
    for r in df.withColumn("b", quality.binomial_below(F.col("n"), F.col("k"), F.col("p"))).collect():
        want = 1.0 if r.k >= r.n * r.p else sum(math.comb(r.n, i) * r.p**i * (1 - r.p) ** (r.n - i) for i in range(r.k + 1))
        assert math.isclose(r.b, want, rel_tol=1e-8)


def test_packing(docs, empty):
    got = packing.pack(docs, P.path("byte_bpe_50k.json"), window=64).collect()
    total = sum(len(ids_of("byte_bpe_50k.json", r[1])) + 1 for r in ROWS)
    assert sum(r.length for r in got) == total
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at == 64 or at & (at - 1) == 0
    assert packing.pack(empty, P.path("byte_bpe_50k.json")).count() == 0


def plain_shard(key, shards, region=4, rack=2):
    """Region, rack and shard by the least draw of each level; hashes as Spark's xxhash64 makes them, one column after the other."""

    def least(level, children):
        draws = []
        for child, below in children:
            h = xxhash.xxh64_intdigest(f"{sharding.SEED}/{level}/{child}".encode(), xxhash.xxh64_intdigest(key.encode(), 42))
            draws.append((-math.log(((h >> 11) + 1) * 2.0**-53) / len(below), child, below))
        return min(draws)[2]

    groups = lambda xs, size: sorted({x // size: [y for y in xs if y // size == x // size] for x in xs}.items())
    found = least("region", groups(list(range(shards)), region))
    found = least("rack", groups(found, rack))
    return least("shard", [(x, [x]) for x in found])[0]


def test_sharding(spark, docs, empty):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(ROWS)
    texts = collections.defaultdict(list)
    for r in ROWS:
        texts[r[0]].append((r[1] or "").encode())
    slots = collections.defaultdict(list)
    for r in got:
        raw = texts[r.doc_id][0]
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (plain_shard(key, 16), plain_shard(key, 17)) and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(empty).count() == 0
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit(3).alias("slot"), F.lit(1).alias("_rank"))
    share = collections.Counter(r.shard for r in sharding.shard_documents(many).collect())
    assert len(share) == 16 and all(170 < n < 330 for n in share.values())


def test_nearest(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(200)] + [(200 + i, [1.0] * 8) for i in range(40)]
    rows += [(900, None), (901, []), (902, [0.0] * 8), (903, [float("nan")] * 8), (904, [1.0, None]), (905, [1.0, 2.0]), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int")
    got = collections.defaultdict(list)
    for r in ann.nearest(df).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    x = np.array([r[1] for r in rows[:240]], np.float32).astype(float)
    norm, hit = np.sqrt((x * x).sum(1)), 0
    for q in (0, 50, 100, 150, 200):
        s = (x @ x[q]) / norm / norm[q]
        s[q] = -9
        hit += len({int(i) for i in np.lexsort((np.arange(240), -np.round(s, 12)))[:5]} & {v for _, v, _ in got[q]})
    assert sorted(got) == [0, 50, 100, 150, 200] and hit >= 23
    assert [v for _, v, _ in sorted(got[200])] == [201, 202, 203, 204, 205]


@pytest.mark.parametrize(("n", "dim"), [(5, 64), (9, 3), (1, 16), (2, 1)])
def test_nearest_is_whole_for_few_rows(spark, n, dim):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    many = rng.standard_normal((300, 32)).astype(np.float32)
    rows = [(50 * i, r.tolist()) for i, r in enumerate(x)] + [(1001 + i, r.tolist()) for i, r in enumerate(many)]
    got = collections.defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    x = x.astype(float)
    norm = np.sqrt((x * x).sum(1))
    for q in range(n):
        s = (x * x[q]).sum(1) / (norm[q] * norm)
        want = [50 * i for i in np.lexsort((np.arange(n), -s)).tolist() if i != q][:5]
        assert sorted(got[50 * q]) == list(enumerate(want, 1))


def plain_dropout(m, word, rate, rng):
    """Best candidate first, leftmost on ties; each is skipped with chance rate and then never tried again."""
    parts, gone = list(word), set()
    while True:
        at = np.cumsum([0, *map(len, parts)]).tolist()
        best = min(((m.rank[a + b], at[i], i, a + b) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)) if a + b in m.rank and (at[i], a + b) not in gone), default=None)
        if best is None:
            return tuple(parts)
        _, place, i, p = best
        if rng.random() < rate:
            gone.add((place, p))
        else:
            parts[i : i + 2] = [p]


def test_merge_dropout_varies_by_occurrence():
    path, n, rate, rng = P.path("piece_bpe_32k.model"), 20000, 0.1, np.random.default_rng(3)
    m = merge_dropout.Pieces(path)
    for word in ("of", "house", "internationalisation"):
        text = " ".join([word] * n)
        raw = m.encode(text, "k", rate)
        assert m.decode(raw) == text and raw == merge_dropout.Pieces(path).encode(text, "k", rate)
        got, want = collections.Counter(), collections.Counter(plain_dropout(m, "\u2581" + word, rate, rng) for _ in range(n // 4))
        ids = [m.texts[i].decode().replace(" ", "\u2581") for i in np.frombuffer(raw, "<u4").tolist()]
        starts = [i for i, x in enumerate(ids) if x[0] == "\u2581"] + [len(ids)]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            got[tuple(ids[a:b])] += 1
        assert sum(got.values()) == n and all(abs(got[x] / n - 4 * want[x] / n) < 0.025 for x in {*got, *want})
        assert word == "of" or len(got) > 4
    assert len({m.encode("house " * 50, k, rate, seed) for k in ("a", "b") for seed in (1, 2)}) == 4
    assert np.frombuffer(m.encode("house", "k", 1.0), "<u4").tolist() == [m.ids[c] for c in "\u2581house"]


def test_nearest_ties_of_parallel_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal(16).astype(np.float32).astype(float)
    ids = (50 * rng.permutation(900) + rng.integers(1, 50, 900)).tolist()
    tied, rest = ids[:80], ids[80:]
    rows = [(60000, x.tolist())] + [(i, (x * 2.0 ** (n - 40)).tolist()) for n, i in enumerate(tied)] + [(i, (x + rng.standard_normal(16) / 9).tolist()) for i in rest]
    rows += [(tied[0], (x * 2.0**n).tolist()) for n in range(45, 60)]
    got = sorted((r.rank, r.vec_id) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tables=1).collect() if r.query_id == 60000)
    assert got == list(enumerate(sorted(tied)[:5], 1))


@pytest.mark.parametrize(("n", "clusters", "dim"), [(3000, 0, 32), (15000, 0, 32), (3000, 60, 32), (15000, 300, 32), (100, 0, 64), (300, 0, 64), (511, 0, 64), (600, 0, 64), (400, 0, 256), (1000, 0, 768), (1000, 50, 768)])
def test_nearest_recall(spark, n, clusters, dim):
    """At many sizes and lengths, with and without structure: recall against brute force, exact scores and order."""
    rng, every = np.random.default_rng(n + clusters), 50 if n >= 3000 else 4
    x = rng.standard_normal((n, dim))
    if clusters:
        x = rng.standard_normal((clusters, dim))[rng.integers(0, clusters, n)] + 0.3 * x
    x = x.astype(np.float32)
    got = collections.defaultdict(list)
    for r in ann.nearest(spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, t string, rank int").repartition(4), every=every).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    x = x.astype(float)
    norm, hit = np.sqrt((x * x).sum(1)), 0
    assert sorted(got) == list(range(0, n, every))
    for q, found in got.items():
        s = (x @ x[q]) / norm / norm[q]
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and all(abs(s[v] - score) < 1e-12 for _, v, score in found)
        s[q] = -9
        hit += len(set(np.argsort(-s)[:5].tolist()) & {v for _, v, _ in found})
    assert hit >= 0.9 * 5 * len(got)


def test_nearest_empty_and_large_components(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert ann.nearest(none).count() == 0
    big = [(50, [1e300, 1e300]), (1, [1e-300, 1e-300]), (2, [1e300, -1e300]), (None, [1.0, 1.0])]
    got = sorted((r.rank, r.vec_id, round(r.score, 9)) for r in ann.nearest(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1.0), (2, 2, 0.0)]


def test_buckets_of_pairs_are_nearest_first():
    x = np.random.default_rng(4).standard_normal((700, 16))
    y, z = ann.signed(x, 0), ann.signed(x, 1)
    got = ann.buckets(x, 0, 40, True)
    for r in range(700):
        full = (y[r][:, None] + z[r][None, :]).reshape(-1)
        assert np.allclose(full[got[r]], -np.sort(-full)[:40])


def test_long_texts_and_empty_tables(spark, empty):
    import sentencepiece

    path, long = P.path("piece_bpe_32k.model"), " ".join(f"word{i % 977}é" for i in range(120_000)) + " <|endoftext|> " + "x" * 100_000
    docs = spark.createDataFrame([(1, long, "en"), (2, None, "en"), (1, long, "en")], "doc_id long, text string, lang string").withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    assert merge_dropout.round_trip(empty, path).count() == 0 and merge_dropout.decode(merge_dropout.encode(empty, path), path).count() == 0
    got = sorted((r.doc_id, r.n_tokens, r.ids_crc32, r.lossless) for r in merge_dropout.round_trip(docs, path).collect())
    assert got[0] == got[1] and got[2][:2] == (2, 0) and all(r[3] for r in got)
    plain = merge_dropout.encode(docs, path, rate=0.0)
    want = sentencepiece.SentencePieceProcessor(model_file=path).encode(long)
    assert [np.frombuffer(r.ids, "<u4").tolist() == (want if r.doc_id == 1 else []) for r in plain.collect()] == [True] * 3
    assert {r.doc_id: r.text for r in merge_dropout.decode(plain, path).collect()} == {1: long, 2: ""}
    pieces = packing.pack(docs.filter("text is not null").limit(1), P.path("byte_bpe_50k.json")).collect()
    assert sum(r.length for r in pieces) == len(ids_of("byte_bpe_50k.json", long)) + 1 and {r.doc_tokens for r in pieces} == {sum(r.length for r in pieces)}
    assert {(r.doc_id, r.size) for r in sharding.shard_documents(docs).collect()} == {(1, len(long.encode()) + 1), (2, 1)}
    assert {r.lang_pred for r in langid.language_id(docs).collect()} == {"en", "und"}


@pytest.mark.parametrize("rate", [0.05, 0.3, 0.8])
def test_merges_one_by_one_and_together_agree(rate):
    """The agenda of one word and the steps for many at once: the same ids and candidates for the same draws, word by word."""
    model = merge_dropout.pieces(P.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(6)
    letters = list("abcdefghilmnoprstuvyéàüñ")
    words = ["".join(rng.choice(letters, int(rng.integers(1, merge_dropout.SHORT + 1)))) for _ in range(600)] + ["retitioning", "internationalisation", "aaaaaaaaaaaa", "the", "s"] * 8
    words = [w for w in [merge_dropout.SPACE + w for w in words] + words if len(w) <= merge_dropout.SHORT]
    keys = rng.integers(0, 2**63, len(words), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    places = rng.integers(0, 10**6, len(words))
    first = merge_dropout.gaps(keys, places, np.zeros(len(words), np.int64), rate)
    many, counts, _ = model.merge_many(words, keys, places, first, rate)
    differ = 0
    for w, k, p, f, ids, n in zip(words, keys.tolist(), places.tolist(), first.tolist(), many, counts.tolist(), strict=True):
        one = model.merge(w, model._skips([f], k, p, rate))
        assert one == (ids, n), w
        differ += ids != model.merge(w, iter([merge_dropout.NEVER]))[0]
    assert differ > 50
