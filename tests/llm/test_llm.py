import functools
import hashlib
import itertools
import random
import re
import tracemalloc
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfold.llm import common, fingerprint, langid, line_dedup, mixing, ngram_join, packing, pii, quality, queries, token_counts, topk

SMALL = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, size long, score string"
ODD = [
    (1, None, None, None, None, 7, "x"), (2, "", "en", "a", 0, None, None), (3, "\n \t\n", "en", "b", 4, 1, "y"), (4, "one two three four five six", "en", "a", 27, 1, "z"),
    (5, "one two three four five six", "en", "b", 27, 1, "z"), (5, "one two three four five six", "en", "b", 27, 1, "z"), (6, "word " * 20000, "de", "c", 100000, 1, "q"), (7, "日本語 ÄÖ \U0001f600 x@y.zz 10.0.0.1", "fr", None, 30, 1, ""),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_odd_rows_and_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([(2, 1, 0), (4, 1, 0), (4, None, None), (6, 0, 1)], "doc_id long, quality int, toxic int")
    net = quality.learn_quality(odd, labels)
    model = langid.learn_languages(odd)
    path = queries.tokenizer_path()
    for table, n in ((odd, len(ODD)), (empty, 0)):
        assert line_dedup.remove_boilerplate(table, min_sites=2).count() == n
        assert pii.detect_pii(table).count() == n
        assert fingerprint.compare_neighbours(table).count() == n
        assert quality.score_quality(table, net).where("score between 0 and 1").count() == n
        assert mixing.mix_sources(table).count() == n
        assert langid.identify_languages(table, model).count() == n
        assert ngram_join.similar_components(table).count() == min(n, 7)
        assert packing.pack_documents(table, path).select("doc_id").distinct().count() == min(n, 7)
    parts = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_components(odd).collect()}
    assert parts == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}
    assert {r["lang_pred"] for r in langid.identify_languages(odd.where("doc_id < 4"), model).collect()} == {"und"}


def test_line_dedup_keeps_first_and_takes_short_lines(spark):
    lines = ["a line of five words", "All rights reserved.", "版权所有", "Es."]
    rows = [(i, "\n".join([f"own {i} text", *lines[: 4 if i < 4 else 3], "", " \t"]), None, f"s{i}", 0, 0, "") for i in range(6)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_boilerplate(spark.createDataFrame(rows, DDL)).collect()}
    assert got[0].split("\n") == ["own 0 text", *lines, "", " \t"]
    assert all(got[i].split("\n") == [f"own {i} text", *(["Es."] if i < 4 else []), "", " \t"] for i in range(1, 6))


def test_names_that_clash(spark, odd):
    """Columns named as an operator's own ones stay as they were."""
    df = odd.withColumn("n_removed", F.lit("mine")).withColumn("__cuts", F.col("doc_id")).withColumn("__cut_id", F.lit(1)).withColumn("slot", F.lit("s")).withColumn("target", F.lit("t")).withColumn("kept", F.lit(0))
    out = line_dedup.remove_boilerplate(df, min_sites=2)
    assert out.columns == [*df.columns, "n_removed_"] and {r["n_removed"] for r in out.collect()} == {"mine"} and out.agg(F.sum("n_removed_")).first()[0] > 0
    mix = mixing.mix_sources(df, keep=("size", "slot", "target", "kept"))
    assert mix.columns == ["doc_id", "size", "source", "source_size", "target", "taken", "size_", "slot", "target_", "kept"] and {r["target_"] for r in mix.collect()} == {"t"}
    assert fingerprint.compare_neighbours(df.withColumn("range", F.lit(1)).withColumn("top", F.lit(1))).count() == len(ODD)
    vectors = spark.createDataFrame([(i, [float(i), 1.0], "x", 1) for i in (0, 1, 50)], "vec_id long, embedding array<double>, cell string, dim int")
    assert topk.top_inner_products(vectors).count() == 4


def test_ledger_is_idempotent_and_compacts(spark, tmp_path):
    ledger = token_counts.TokenLedger(spark, str(tmp_path / "ledger"))
    assert ledger.totals().count() == 0
    docs = spark.createDataFrame([(2, "s", "en"), (0, "s", "en"), (1, None, None)], "n long, source string, lang string")
    assert ledger.commit("one", token_counts.inserted(docs, "words@1", "n")) and not ledger.commit("one", token_counts.inserted(docs, "words@1", "n"))
    before = sorted(map(tuple, ledger.totals().collect()), key=str)
    assert ledger.compact("now")
    assert sorted(map(tuple, ledger.totals().collect()), key=str) == before and not ledger.commit("one", token_counts.inserted(docs, "words@1", "n"))
    # a name used before does nothing, whatever was committed since; a fold whose writer died counts for nothing
    ledger.commit("two", token_counts.inserted(docs, "words@1", "n"))
    assert not ledger.compact("now") and ledger.totals().agg(F.sum("n_docs")).first()[0] == 6
    ledger._mark("fold-00000002", '{"names": ["cut')
    assert ledger.totals().agg(F.sum("n_docs")).first()[0] == 6
    # two folds made at once: the higher one holds all
    state = ledger._state()
    assert ledger.compact("a")
    ledger._state = lambda: state
    assert ledger.compact("b")
    del ledger._state
    assert ledger.totals().agg(F.sum("n_docs")).first()[0] == 6 and not ledger.commit("two", token_counts.inserted(docs, "words@1", "n"))
    ledger.commit("gone", token_counts.inserted(docs, "words@1", "n", sign=-1))
    ledger.commit("gone too", token_counts.inserted(docs, "words@1", "n", sign=-1))
    assert ledger.totals().count() == 0


def brute_tokens(version):
    import base64

    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    if version == "word_bpe_49k@1":
        words = Tokenizer.from_file(P.path("word_bpe_49k.json"))
        return lambda t: len(words.encode(t, add_special_tokens=False).ids)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return lambda t: len(tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(t))


def test_token_totals_equal_brute_force(spark):
    """op2 over its tables: documents that are not toxic, those of quality 0 without repeated lines, under both vocabularies."""
    labels = {}
    for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect():
        q, x = labels.get(r["doc_id"], (1, 0))
        labels[r["doc_id"]] = (min(q, r["quality"]), max(x, r["toxic"]))
    want = {}
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    for version in token_counts.TOKENIZERS:
        count = brute_tokens(version)
        for r in rows:
            q, toxic = labels.get(r["doc_id"], (1, 0))
            t = r["text"] or ""
            if q == 0:
                t = "\n".join(dict.fromkeys(t.split("\n")))
            if not toxic:
                n, k = want.get((r["source"], r["lang"], version), (0, 0))
                want[r["source"], r["lang"], version] = n + 1, k + count(t)
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in queries.op2_token_counts(spark, SMALL).collect()}
    assert got == want


def test_token_counts_of_odd_rows(spark, odd):
    df = odd.withColumn("once", F.when(F.col("doc_id") == 6, F.lit("word")).otherwise(F.col("text")))
    out = token_counts.with_counts(df, {"size": F.col("size"), "id": F.col("doc_id")}, {"": F.col("text"), "once": F.col("once")})
    assert out.columns == ["size", "id", *token_counts.TOKENIZERS, *(f"{v}/once" for v in token_counts.TOKENIZERS)]
    for v in token_counts.TOKENIZERS:
        count = brute_tokens(v)
        got = sorted((r["id"], r[v], r[f"{v}/once"]) for r in out.collect())
        assert got == sorted((r[0], count(r[1] or ""), count("word" if r[0] == 6 else r[1] or "")) for r in ODD)


def slow_base(t):
    out = []
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub(r"[^0-9]", "", m[0])
            if (k == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (k == "card" and not (12 <= len(d) <= 19 and pii.luhn(d))) or (k == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_equal_plain_patterns():
    r = random.Random(1)
    for _ in range(5000):
        t = "".join(r.choice("a1.@+- ()x23-.@1é") for _ in range(r.randint(0, 40)))
        assert slow_base(t) == pii.base_spans(t), t


def test_field_finds_forms_without_pattern():
    field = pii.field_from(pii.trained_field())
    text = "call (212) 555-0187 or write to ann at example dot com today, order 20394"
    base, every = pii.find_spans(text, field)
    assert base == [] and ("phone" in {k for _, _, k in every}) and all(text[a:b] in ("(212) 555-0187", "ann at example dot com") for a, b, _ in every)
    hits = total = wrong = 0
    for t, gold in pii.examples(200, seed=99):
        got = set(field.decode(pii.Region(t, 0, len(t))))
        hits, total, wrong = hits + len(got & set(gold)), total + len(gold), wrong + len(got - set(gold))
    assert hits / total > 0.85 and wrong / total < 0.15


def test_recall_on_documents(spark):
    """Personal data planted in the documents, by plain forms apart from other digits: found at their exact places."""
    field = pii.field_from(pii.trained_field())
    forms = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])", "card": r"(?<![0-9])[0-9]{16}(?![0-9])",
        "phone": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "secret": r"(?i)(?<=token = \")[0-9a-f]{40}",
    }
    hits, total, beyond = {}, {}, 0
    for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").where("text IS NOT NULL").collect():
        found = set(pii.find_spans(r["text"], field)[1])
        gold = {(m.start(), m.end(), k) for k, p in forms.items() for m in re.finditer(p, r["text"]) if (k != "card" or pii.luhn(m[0])) and (k != "ip" or max(map(int, m[0].split("."))) < 256)}
        for g in gold:
            total[g[2]] = total.get(g[2], 0) + 1
            hits[g[2]] = hits.get(g[2], 0) + (g in found)
        beyond += len(found - gold)
    assert all(total[k] > 100 and hits[k] >= 0.95 * total[k] for k in forms) and beyond < 0.02 * sum(total.values()), (hits, total, beyond)


def test_long_texts_take_linear_time():
    import time

    field = pii.field_from(pii.trained_field())
    r = random.Random(1)
    address = lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))
    for make in (lambda n: " word ".join(address() for _ in range(n)), lambda n: " ".join(str(r.randint(0, 999)) for _ in range(n))):
        took = []
        for n in (1000, 8000):
            text, began = make(n), time.process_time()
            pii.find_spans(text, field)
            took.append(time.process_time() - began)
        assert took[1] < 24 * max(took[0], 0.02)


def test_segments_touch_no_span_found_before():
    text = "id 4111111111111111 12 345 6789 at 10.0.0.1 99"
    taken = [(3, 19), (35, 43)]
    region = pii.Region(text, 0, len(text), taken)
    free = pii.Region(text, 0, len(text))
    spans = {(region.tokens[i][0], region.tokens[j - 1][1]) for j in region.spans for i, _ in region.spans[j]}
    every = {(free.tokens[i][0], free.tokens[j - 1][1]) for j in free.spans for i, _ in free.spans[j]}
    assert spans == {(a, b) for a, b in every if not any(x < b and a < y for x, y in taken)} and spans


def test_whole_texts_give_spelled_out_addresses():
    field = pii.field_from(pii.trained_field())
    forms = ["ann at example.com", "ann at example dot com", "ann at example[dot]com", "ann at example(dot)com", "ann[at]example.com", "ann(at)example dot com"]
    for form in forms:
        for before, after in (("please write to ", " soon"), ("x 7 write to ", " or 12 "), ("", ""), ("many words " * 20 + "mail ", " and no more" * 20)):
            text = before + form + after
            where = (len(before), len(before) + len(form))
            assert any(x <= where[0] and where[1] <= y for x, y in pii.regions(text, [])), text
    # a cue 32 characters behind another
    text = "7 " + "ab " * 9 + "xy at " + "a" * 37 + ".com end"
    assert any(x <= 29 and 76 <= y for x, y in pii.regions(text, []))
    assert pii.regions("she was at home and looked at it", []) == []
    hits = total = wrong = 0
    for t, gold in pii.examples(400, seed=99):
        got = {s for s in pii.find_spans(t, field)[1] if s[2] == "email"}
        gold = {s for s in gold if s[2] == "email"}
        hits, total, wrong = hits + len(got & gold), total + len(gold), wrong + len(got - gold)
    assert hits / total > 0.75 and wrong / total < 0.3, (hits, total, wrong)


def test_fingerprints_against_plain_text(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy(F.desc("doc_id")).collect()
    got = {r["doc_id"]: r for r in queries.op4_fingerprints(spark, SMALL).collect()}
    for i, r in enumerate(rows):
        t, nxt = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        g = got[r["doc_id"]]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and 0 <= g["near_next"] <= 1
    assert np.mean([g["near_edited"] > g["near_next"] for g in got.values()]) > 0.95


def test_fingerprints_equal_brute_force(spark):
    """Lanes, counts and both likenesses of every document of the small table, by plain loops over its paragraphs and word pairs."""
    import struct

    import xxhash

    chain = lambda *parts: __import__("functools").reduce(lambda seed, part: xxhash.xxh64_intdigest(part, seed=seed), parts, 42)
    white = "[\x20\x09-\x0d]+"

    def slow(text):
        pars = [x for x in text.split("\n") if re.sub(white, "", x)]
        lanes = [sum(chain(struct.pack("<i", j), x.encode()) & 0xFFFFFFFF for x in pars) & 0xFFFFFFFF for j in range(fingerprint.HASH_LANES)]
        hashes = []
        for x in pars:
            words = [w.encode() for w in re.split(white, x) if w]
            hashes += [chain(a, b) for a, b in itertools.pairwise(words)] if len(words) > 1 else [chain(w) for w in words]
        counts = np.zeros(64, dtype=np.int64)
        for bit in range(64):
            counts[bit] = int(((np.array(hashes, dtype=np.uint64) >> np.uint64(bit)) & np.uint64(1)).sum())
        bits = [int(counts[bit]) for j in range(32) for bit in (j, j + 32)]
        return lanes, bits, len(hashes)

    def near(a, b):
        if a == b:
            return 1.0
        x, y = (2 * np.array(f[1], dtype=float) - f[2] for f in (a, b))
        norm = np.sqrt((x @ x) * (y @ y))
        return max(0.0, min(0.999999, x @ y / norm)) if norm > 0 else 0.0

    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy(F.desc("doc_id")).collect()
    got = {r["doc_id"]: r for r in queries.op4_fingerprints(spark, SMALL).collect()}
    prints = [slow(r["text"] or "") for r in rows]
    written = lambda f: "".join(f"{v:08x}" for v in f[0]) + ":" + "".join(f"{v:08x}" for v in f[1]) + f":{f[2]:X}"
    for i, r in enumerate(rows):
        t, nxt = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        edited = slow(t[: len(t) - len(t) // 3] + nxt[: len(t) // 3])
        g = got[r["doc_id"]]
        assert g["fingerprint"] == written(prints[i]) and g["edited_fingerprint"] == written(edited)
        assert abs(g["near_edited"] - near(prints[i], edited)) < 1e-6 and abs(g["near_next"] - near(prints[i], prints[(i + 1) % len(rows)])) < 1e-6


def test_fingerprints_of_null_ids_and_wrapping(spark):
    """Rows of null id come last, in order of their texts; the last row's next is the first. Ranges of any size give the same."""
    rows = [(None, "zz a b c"), (None, "aa a b c"), (None, "aa a b c"), (5, "five words are in here"), (7, "seven x y z"), (7, "again seven x y z")]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for i, (name, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        want.append((str(name), hashlib.sha256((t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]).encode()).hexdigest()))
    for size in (1, 2, 1500):
        out = fingerprint.compare_neighbours(spark.createDataFrame(rows, "doc_id long, text string"), range_rows=size).collect()
        assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in out) == sorted(want)


def test_fingerprint_is_a_multiset_sum(spark):
    df = spark.createDataFrame([("a b\nc d\ne f", "e f\na b", "c d", "c d\ne f\na b")], "whole string, part string, rest string, shuffled string")
    for c in df.columns:
        df = fingerprint.with_fingerprint(df, c, f"f_{c}")
    r = df.select((fingerprint.combine(F.col("f_part"), F.col("f_rest")) == F.col("f_whole")).alias("x"), (fingerprint.combine(F.col("f_whole"), F.col("f_part"), -1) == F.col("f_rest")).alias("y"), (F.col("f_shuffled") == F.col("f_whole")).alias("z")).first()
    assert r["x"] and r["y"] and r["z"]


def test_likeness_counts_all_64_bits(spark):
    r = random.Random(5)
    sizes = [0, 1, 126, 127, 128, 254, 255, 1200]
    rows = [(n, [r.choice([-1, -1, 0, 1 << 63, r.getrandbits(64)]) for _ in range(n)]) for n in sizes] + [(500, [-1] * 500)]
    signed = [(n, [h - (1 << 64) if h >= 1 << 63 else h for h in (x & (1 << 64) - 1 for x in hs)]) for n, hs in rows]
    df = spark.createDataFrame(signed, "n long, hashes array<long>").select("n", fingerprint.unpack(fingerprint.bit_sums(F.col("hashes"))).alias("bits"))
    got = {x["n"]: x["bits"] for x in df.collect()}
    for n, hs in rows:
        assert got[n] == [sum(h >> bit & 1 for h in hs) for j in range(32) for bit in (j, j + 32)]
    df = fingerprint.with_fingerprint(spark.createDataFrame([("a b c",)], "t string"), "t", "f")
    assert len(df.first()["f"]["bits"]) == 64


def test_quality_accuracy_on_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op5_quality(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert got.select(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95


def test_quality_gradients_are_those_of_the_loss():
    """The fit's gradients against differences of the log loss, over chunks of several lengths."""
    r = np.random.default_rng(2)
    net = quality.ByteNet(seed=4)
    net.kernel, net.out = net.kernel.astype(np.float64), net.out.astype(np.float64)
    parts = [quality.windows(np.frombuffer(bytes(r.integers(97, 105, n).astype(np.uint8)), np.uint8)) for n in (3, 40, 200)]
    labels, weights = np.array([1, 0, 1]), np.array([0.2, 0.5, 0.3])

    def loss():
        total = 0.0
        for x, y, w in zip(parts, labels, weights, strict=True):
            hidden = np.maximum(sum(net.kernel[i][x[:, i]] for i in range(quality.WIDTH)) + net.bias, 0)
            p = 1 / (1 + np.exp(-(np.concatenate([hidden.max(axis=0), hidden.mean(axis=0)]) @ net.out + net.out_bias)))
            total -= w * np.log(p if y else 1 - p)
        return total

    grads, _ = net._gradients(parts, labels, weights)
    for at in [(0, 97, 1), (3, 100, 5), (7, 104, 0)]:
        net.kernel[at] += 1e-5
        up = loss()
        net.kernel[at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - grads[0][at]) < 1e-4
        net.kernel[at] += 1e-5
    for j in (0, quality.FILTERS + 2):
        net.out[j] += 1e-5
        up = loss()
        net.out[j] -= 2e-5
        assert abs((up - loss()) / 2e-5 - grads[2][j]) < 1e-4
        net.out[j] += 1e-5


def test_quality_stage_on_odd_rows(spark, odd, empty):
    net = quality.ByteNet()
    df = odd.withColumn("predicted", F.lit("mine"))
    scorer = quality.Scorer(net)
    kept = quality.keep_quality(df, net)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in ODD if scorer.score(r[1]) >= 0.3)
    assert quality.keep_quality(empty, net).count() == 0


def test_quality_shared_pass_equals_chunks():
    net = quality.ByteNet()
    scorer = quality.Scorer(net)
    for n in (0, 3, 1024, 1025, 5000, 1024 + 7 * 896):
        text = "".join(random.Random(n).choice("abc é.\n") for _ in range(n))
        slow = scorer.logits(text.encode())
        assert abs(scorer.score(text) - 1 / (1 + np.exp(-slow.mean()))) < 1e-5


def brute_components(rows):
    sets = {i: ngram_join.shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(sets[a]) and len(sets[b]) and ngram_join.linked(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("hot, block", [(ngram_join.HOT_LIST, 512), (2, 2)])
def test_join_equals_brute_force_on_near_copies(spark, monkeypatch, hot, block):
    """Also with lists dealt over salts and in small blocks."""
    monkeypatch.setattr(ngram_join, "HOT_LIST", hot)
    monkeypatch.setattr(ngram_join, "cross_pairs", functools.partial(ngram_join.cross_pairs, block=block))
    r = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for g in range(12):
        base = [r.choice(words) for _ in range(r.choice([5, 8, 9, 14, 30, 60, 120]))]
        for _ in range(r.randint(2, 14)):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((len(rows), " ".join(copy)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {x["doc_id"]: x["component_id"] for x in ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), heavy_least=3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_components(rows)


def test_mixing_meets_targets(spark):
    got = mixing.mix_sources(spark.read.parquet(f"{SMALL}/documents.parquet")).toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-3 * by["size"].sum() and ((by.taken - by.target).abs() <= 0.05 * by.target + 60).all()


def test_knapsack_is_nearest():
    r = random.Random(2)
    for _ in range(60):
        lengths = np.array(sorted(r.sample(range(1, 60), r.randint(1, 6))))
        counts = np.array([r.randint(1, 4) for _ in lengths])
        budget = r.randint(0, int((lengths * counts).sum()))
        take = mixing.fit_counts(lengths, counts, budget)
        assert (take <= counts).all() and (take >= 0).all()
        best = min(abs(sum(n * z for n, z in zip(c, lengths, strict=True)) - budget) for c in itertools.product(*(range(k + 1) for k in counts)))
        assert abs(int((take * lengths).sum()) - budget) <= max(best, lengths[-1] // 2 + 1)


def test_topk_equals_brute_force():
    r = np.random.default_rng(0)
    x = np.floor(256 * r.normal(0, 0.125, (3000, 16)))
    x[100:300] = x[5]
    ids = np.arange(3000)
    q = ids % 50 == 0
    search = topk.DualTreeSearch(ids[q], x[q], 5)
    for at in range(0, 3000, 700):
        search.add(ids[at : at + 700], x[at : at + 700])
    scores = x[q] @ x.T
    scores[np.arange(q.sum()), np.flatnonzero(q)] = -np.inf
    assert (np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :5] == search.found).all()


def test_topk_leaves_broken_vectors_out(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (1, None), (2, [float("nan"), 1.0]), (3, [1.0, None]), (4, [1.0, 1.0]), (4, [1.0, 1.0])]
    got = topk.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 4), (0, 50), (50, 4), (50, 0)]
    assert topk.top_inner_products(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def brute_top(rows, k=5):
    out, rows = {}, {(i, tuple(np.floor(256 * np.array(v)))) for i, v in rows}
    for i, v in rows:
        for j, w in rows:
            if i % 50 == 0 and i != j and len(v) == len(w):
                out.setdefault(i, set()).add((-int(np.dot(v, w)), j))
    return {i: sorted(s)[:k] for i, s in out.items()}


def found_top(spark, rows, **how):
    out = {}
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in rows], "vec_id long, embedding array<double>")
    for r in topk.top_inner_products(df, **how).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    return out


def test_topk_with_repeated_rows_and_lengths(spark):
    rows = [(0, [1, 0]), *[(1, [1, 0])] * 8, *((i, [0.5, i / 10]) for i in range(2, 8)), (7, [0.5, -0.7]), (50, [1, 1]), (50, [0, 1]), (100, [1, 2, 3]), (101, [1, 2, 1]), (150, [])]
    assert found_top(spark, rows) == brute_top(rows)


def test_topk_over_many_blocks(spark):
    """Many query blocks, data blocks and groups; clusters to prune, and one vector that a third of the ids have."""
    r = np.random.default_rng(3)
    rows = [(i, r.normal(0, 0.3, 8) + 2 * (i % 7 == np.arange(8))) for i in range(2000)] + [(2000 + i, np.full(8, 0.25)) for i in range(1000)]
    how = dict(query_bytes=64 * 8 * 8, block_rows=128, group_rows=256, sample_rows=200, centers=10)
    assert found_top(spark, rows, **how) == brute_top(rows)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op9_packing(spark, SMALL).toPandas()
    for i, g in got.groupby("doc_id"):
        ids = np.array(tokenizer.encode(texts[i], add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for p in g.sort_values("start").itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes()) and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids)
    ends = got.assign(end=got.offset + got.length).groupby("sequence_id").agg(first=("offset", "min"), end=("end", "max"), sum=("length", "sum"))
    assert (ends["first"] == 0).all() and (ends.end == ends["sum"]).all() and ends.end.max() <= 2048


def test_packing_leaves_little_padding(spark):
    """Under 2 % of all windows, but for the end of each input partition."""
    got = packing.pack_documents(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").coalesce(1), queries.tokenizer_path())
    r = got.agg(F.sum("length").alias("tokens"), F.countDistinct("sequence_id").alias("windows")).first()
    assert r["windows"] > 1000 and r["tokens"] / (2048 * r["windows"]) > 0.98


def test_language_sample_spans_the_text(spark):
    for n in (0, 1, 399, 400, 401, 799, 800, 1199, 5000):
        got = langid.spread_words(list(range(n)), 400)
        assert len(got) == len(set(got)) == min(n, 400) and (n <= 400 or np.diff([*got, n]).max() <= -(-n // 400))
    docs = spark.createDataFrame([(i, "ab " * 400 + "zuletzt " * 300, "de") for i in range(3)], "doc_id long, text string, lang string")
    assert "zuletzt" in langid.learn_languages(docs).words


def test_language_of_texts_without_letters(spark):
    texts = ["½ ²", "Ⅷ 12 ③", "__ 7", "", None, "½ una palabra ²", "\u0301"]
    rows = [(3 * i, t, "es" if i % 2 else "de") for i, t in enumerate(["das Haus ist alt", "una casa vieja", "der alte Baum", "una palabra nueva"] * 6)]
    model = langid.learn_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = langid.identify_languages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["und"] * 5 + ["es", "und"]
    assert langid.words_of("Ab½cd_e1f Ⅷ日本") == ["ab", "cd", "e", "f", "日本"]


def test_language_equals_brute_force(spark):
    """Every prediction is that of a plain walk over the words: known ones by their vector, others by the longest n-grams."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.learn_languages(docs)
    got = {r["doc_id"]: r for r in queries.op10_language(spark, SMALL).collect()}
    for r in docs.collect():
        words = "".join(c if c.isalpha() else " " for c in (r["text"] or "").lower()).split(" ")
        vectors = [model.words[w] if w in model.words else model.back_off(w) for w in words if w]
        if not vectors:
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        logits = model.prior + np.mean(vectors, axis=0) * min(len(vectors), 20)
        p = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
        assert abs(got[r["doc_id"]]["score"] - p.max()) < 1e-3 and (p.max() < 0.501 or got[r["doc_id"]]["lang_pred"] == model.langs[int(p.argmax())])


def test_language_accuracy_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_language(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SMALL).cache()
        assert docs.count() > 0
        if name != "packing":
            assert docs.columns == columns
        if name == "line_dedup":
            assert docs.count() == before.count()
    assert docs.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_pipeline_stages_on_odd_rows(spark, odd, empty, tmp_path):
    """Nulls in every column, empty, very long and repeated texts, ties, clashing extra columns and empty tables pass every stage."""
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    sf = str(tmp_path)
    more = odd.union(spark.createDataFrame([(None, "no id", None, None, None, 1, "")], DDL)).withColumn("slot", F.lit(1)).withColumn("n_removed", F.lit("x"))
    kept = stages["quality"](spark, more, sf)
    assert kept.columns == corpus_pipeline.COLUMNS and kept.count() == len(ODD) + 1
    lines = stages["line_dedup"](spark, more, sf)
    assert lines.columns == corpus_pipeline.COLUMNS and lines.count() == len(ODD) + 1 and lines.where("doc_id = 1 AND text IS NULL").count() == 1
    single = stages["near_duplicates"](spark, more, sf)
    assert single.columns == corpus_pipeline.COLUMNS and sorted(str(r["doc_id"]) for r in single.collect()) == ["1", "2", "3", "4", "6", "7", "None"]
    mixed = stages["mixing"](spark, more, sf)
    assert mixed.columns == corpus_pipeline.COLUMNS and mixed.where("text IS NULL OR trim(text) = ''").count() == 0 < mixed.count()
    assert stages["packing"](spark, more, sf).where("doc_id = 1 AND doc_tokens = 1").count() == 1
    for stage in stages.values():
        assert stage(spark, empty, sf).count() == 0


def brute_lines(rows):
    """Texts by row without lines on five sites or more, but for the first place of each."""
    white = "\x20\t\n\x0b\x0c\r"
    sites, first = {}, {}
    for r in rows:
        for pos, line in enumerate((r["text"] or "").split("\n")):
            if line.strip(white):
                k = line.strip(white)
                sites.setdefault(k, set()).add(r["source"] or "")
                first[k] = min(first.get(k, (r["doc_id"], pos)), (r["doc_id"], pos))
    gone = lambda i, pos, line: line.strip(white) != "" and len(sites[line.strip(white)]) >= 5 and first[line.strip(white)] != (i, pos)
    return {r["doc_id"]: r["text"] and "\n".join(x for pos, x in enumerate(r["text"].split("\n")) if not gone(r["doc_id"], pos, x)) for r in rows}


def brute_targets(sizes):
    """Targets that are one level times the weight, none above twice the size, found by halving."""
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate([*sorted(s for s in sizes if s is not None), *(s for s in sizes if s is None)])}
    low, high = 0.0, 4.0 * sum(sizes.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * n, level * weight[s]) for s, n in sizes.items()) < 1.5 * sum(sizes.values()) else (low, level)
    return {s: min(2 * n, high * weight[s]) for s, n in sizes.items()}


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    plain = lambda df: sorted((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    rows = [r.asDict() for r in docs.collect()]
    good = [r for r in rows if len(r["text"] or "") > 600][:12]
    for k, r in enumerate(good):  # a license line on every second of them, and a near copy with one more word
        if k % 2:
            r["text"], r["source"] = f"{r['text']}\n  planted line of six words ", f"site{k}"
        rows.append(r | {"doc_id": 10**6 + k, "text": f"{r['text']} more"})
    for r in rows:
        r["n_chars"] = len(r["text"] or "")
    sf = str(tmp_path)
    spark.createDataFrame([tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in rows], docs.schema).write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    # quality: the plain score of every whole text
    scorer = quality.Scorer(quality.learn_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    kept = stages["quality"](spark, docs, sf).cache()
    assert plain(kept) == sorted(tuple(r.values()) for r in rows if 1 / (1 + np.exp(-scorer.logits((r["text"] or "").encode()).mean())) >= 0.3)
    assert 0 < kept.count() < len(rows)

    before = kept.collect()
    lines = stages["line_dedup"](spark, kept, sf).cache()
    texts = brute_lines(before)
    assert plain(lines) == sorted((r["doc_id"], t, r["lang"], r["source"], len(t)) for r in before for t in [texts[r["doc_id"]]])
    assert any(texts[r["doc_id"]] != r["text"] for r in before)

    before = lines.collect()
    parts = brute_components([(r["doc_id"], r["text"]) for r in before])
    single = stages["near_duplicates"](spark, lines, sf).cache()
    assert plain(single) == sorted(tuple(r) for r in before if parts[r["doc_id"]] == r["doc_id"])
    assert single.count() < len(before)

    # mixing: whole passes and a rest as near as any choice of documents comes, all columns as they were
    before = {r["doc_id"]: r for r in single.collect()}
    mixed = stages["mixing"](spark, single, sf).cache()
    times = {}
    for r in mixed.collect():
        assert r == before[r["doc_id"]]
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for i, r in before.items()}
    sizes = {}
    for i, r in before.items():
        sizes[r["source"]] = sizes.get(r["source"], 0) + size[i]
    targets = brute_targets(sizes)
    assert len(set(times.values()) | {0}) > 1 and not any(times.get(i) for i in before if not size[i])
    for source, target in targets.items():
        ids = [i for i, r in before.items() if r["source"] == source and size[i]]
        if not ids:
            continue
        passes, reach = int((target + 1e-6) // sizes[source]), 1
        for i in ids:
            reach |= reach << size[i]
        rest = target - passes * sizes[source]
        best = min(abs(n - rest) for n in range(reach.bit_length()) if reach >> n & 1)
        extra = sum((times.get(i, 0) - passes) * size[i] for i in ids)
        assert all(times.get(i, 0) - passes in (0, 1) for i in ids)
        assert abs(extra - rest) <= max(best, max(size[i] for i in ids) // 2) + 1, source

    # packing: every token of every copy in one place
    packed = stages["packing"](spark, mixed, sf).toPandas()
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    assert set(packed.doc_id) == set(times)
    for i, g in packed.groupby("doc_id"):
        ids = np.array(tokenizer.encode(before[i]["text"], add_special_tokens=False).ids + [1], dtype="<u4")
        cover = np.zeros(len(ids), int)
        for p in g.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids)
            cover[p.start : p.start + p.length] += 1
        assert (cover == times[i]).all()
    for _, g in packed.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.iloc[0] == 0 and (g.offset + g.length).iloc[-1] <= 2048 and ((g.offset + g.length).iloc[:-1].values == g.offset.iloc[1:].values).all()

    # the whole run packs the same pieces
    pieces = lambda df: sorted(zip(df.doc_id, df.start, df.length, df.ids_crc32, strict=True))
    assert pieces(corpus_pipeline.run(spark, sf).toPandas()) == pieces(packed)


class Mapped:
    """Stands for a table of one batch; keeps the function that a map over it would run."""

    def __getattr__(self, name):
        return lambda *a: self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


@pytest.mark.parametrize("owner", ["rows", "packing", "lists"])
def test_memory_goes_back_after_the_last_batch(spark, monkeypatch, owner):
    """What a worker gives back between stages holds the last batch and what was made of it as well."""
    run = {
        "rows": lambda: common.map_columns(Mapped(), "doc_id long, text string", lambda: lambda ids, texts: [ids, texts]),
        "packing": lambda: packing.pack_documents(Mapped(), queries.tokenizer_path()),
        "lists": lambda: ngram_join.star_pairs(Mapped()),
    }[owner]()
    seen, left = [], []
    monkeypatch.setattr(common, "release_memory", lambda: left.append([x() is not None for x in seen]))
    if hasattr(packing, "release_memory"):
        monkeypatch.setattr(packing, "release_memory", common.release_memory)
    common._STATE.clear()

    def batches():
        second = pa.array(["one two", "three"]) if owner != "lists" else pa.array([1, 2])
        batch = pa.RecordBatch.from_arrays([pa.array([7, 7]), second, pa.array([3, 3], pa.int32()), pa.array([0, 0], pa.int32())][: 4 if owner == "lists" else 2], names=list("abcd")[: 4 if owner == "lists" else 2])
        seen.append(weakref.ref(batch))
        yield batch

    rows = run(batches())
    assert sum(x.num_rows for x in rows) > 0
    assert left[-1:] == [[False]]
    common._STATE.clear()


def test_repeated_tokens_equal_counts_in_little_memory():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 500):
        held = [rng.integers(0, 60, n, dtype=np.uint64), rng.integers(0, 1 << 64, n, dtype=np.uint64)]
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        got = ngram_join.repeated_tokens(held)
        assert not held and (got[0] == values[counts > 2]).all() and (got[1] == counts[counts > 2]).all()
    held = [np.concatenate([x, x[:10], x[:10]]) for x in rng.integers(0, 1 << 64, (4, 250_000), dtype=np.uint64)]
    mb = sum(x.nbytes for x in held)
    tracemalloc.start()
    assert len(ngram_join.repeated_tokens(held)[0]) == 40
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * mb


def test_stages_with_python_workers_collect_garbage_first_for_memory(spark, empty):
    """A local session's executor is its own JVM, whose full collections can be counted."""
    import corpus_pipeline

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName())
    before = full()
    dict(corpus_pipeline.STAGES)["packing"](spark, empty, SMALL)
    assert full() > before
