"""Each text operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kelpline.llm import bpe_codec, common, conv_quality, hot_groups, lm_scores, near_texts, nn_descent, packing, quality_rules, queries, simhash, substring_dedup, token_counts, url_filter, url_table
from kelpline.llm.components import components
from kelpline.llm.fast_encode import fast
from kelpline.llm.queries import TOKENIZER

LIBRARY = Tokenizer.from_file(TOKENIZER)
EXTRA = "doc_id bigint, text string, lang string, part int, bucket string, ref double, score string"


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(40)]
    texts = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(60)]
    for i in range(0, 60, 4):  # a passage at any offset
        texts[i] = " ".join([word() for _ in range(rng.randint(0, 20))] + passage[rng.randint(0, 8) :] + [word()])
    base = [word() for _ in range(200)]
    for i in range(10):  # near copies, then exact copies
        copy = list(base)
        copy[rng.randrange(200)] = word()
        texts.append(" ".join(copy))
    texts += [texts[3]] * 4 + [None, "", "   \n\t", "one", "one two three", "é<|endoftext|>中文 \u3000x  y\n\n z", "a" * 3000, "Line one\nLine one\nline two\nLine one", " ".join(passage) + "\n" + " ".join(passage), "word " * 9000]
    return [(i * 3 + 1, t, ("en", "de", None)[i % 3], i, "b", 0.5, "s") for i, t in enumerate(texts)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS + ROWS[-3:-2] + [(None, ROWS[0][1], "en", 1, "b", 0.1, "s")], EXTRA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(r[0], int(i % 4 > 0), 0) for i, r in enumerate(ROWS)], "doc_id bigint, quality int, toxic int")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


# -- tokens --------------------------------------------------------------


def test_codec_equals_library(docs, empty):
    got = by_id(bpe_codec.encode_decode(docs, TOKENIZER, ("n_tokens", "ids", "ids_text", "decoded")))
    for key, text, *_ in ROWS:
        want = ids(text)
        assert list(got[key]["ids"]) == want and got[key]["n_tokens"] == len(want)
        assert got[key]["ids_text"] == ",".join(map(str, want)) and got[key]["decoded"] == LIBRARY.decode(want, skip_special_tokens=False) == (text or "")
    assert bpe_codec.encode_decode(docs, TOKENIZER).count() == len(ROWS) + 2
    assert bpe_codec.encode_decode(empty, TOKENIZER).count() == 0


def test_codec_on_random_characters():
    from kelpline.llm.bytebpe import ByteBpe

    bpe, rng = ByteBpe(TOKENIZER), random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(list("ab  \n\t é中12's!\u00a0\u2003") + ["<|endoftext|>", "aaaa"]) for _ in range(rng.randint(0, 40)))
        got = np.frombuffer(b"".join(bpe.encode_batch([text])[0]), "<u4").tolist()
        assert got == ids(text) == fast(TOKENIZER).ids(text).tolist() and bpe.decode(got) == text


def test_counts_splice_chunks(docs, empty):
    got = by_id(token_counts.count_tokens(docs, TOKENIZER, chunk=64, overlap=8))
    for key, text, *_ in ROWS:
        n = len(ids(text))
        assert (got[key]["n_tokens"], got[key]["n_bytes"], got[key]["over_limit"]) == (n, len((text or "").encode()), n > 512)
    assert token_counts.count_tokens(empty, TOKENIZER).count() == 0


def test_overlaps_widen_where_nothing_is_stable():
    encoder, rng = fast(TOKENIZER), random.Random(9)
    for _ in range(60):
        text = "".join(rng.choice(["abc", " ", "  ", "\n", "x" * 90, "<|endoftext|>", "!?", "é"]) for _ in range(60))
        assert token_counts.count_whole(encoder, text, chunk=40, overlap=4) == len(ids(text))


def test_packing_keeps_every_id_once(docs, empty):
    rows = packing.pack_documents(docs, TOKENIZER, capacity=64, group_docs=16, with_ids=True).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    for key, text, *_ in ROWS:
        copies = 2 if key == ROWS[-3][0] else 1
        starts = Counter((r["start"], tuple(r["ids"])) for r in pieces[key])
        assert set(starts.values()) == {copies}
        assert [i for _, part in sorted(starts) for i in part] == [*ids(text), 0]
    for spans in sequences.values():
        at = 0
        for r in sorted(spans, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    filled = packing.padding(packing.pack_documents(docs, TOKENIZER), 1024).first()
    assert filled["ids"] == sum(len(ids(r[1])) + 1 for r in ROWS + ROWS[-3:-2] + ROWS[:1])
    assert packing.pack_documents(empty, TOKENIZER).count() == 0


def test_packing_keeps_large_ids_beside_null(spark):
    big = [2**60 + 1, 2**60 + 3, None, 2**53 + 1]
    frame = spark.createDataFrame([(k, "some words here") for k in big], "doc_id bigint, text string")
    assert sorted(map(str, (r["doc_id"] for r in packing.pack_documents(frame, TOKENIZER).collect()))) == sorted(map(str, big))
    copies = spark.createDataFrame([(1, "same")] * 64, "doc_id bigint, text string").repartition(64)
    assert copies.rdd.getNumPartitions() == 64
    assert packing.pack_documents(copies, TOKENIZER, group_docs=4).select("sequence_id").distinct().count() >= 6


def test_first_fit_decreasing_by_hand():
    sizes = np.random.default_rng(1).integers(1, 101, 300)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    free, want = [], np.zeros(300, int)
    for i in np.argsort(-sizes, kind="stable"):
        b = next((j for j, f in enumerate(free) if f >= sizes[i]), len(free))
        free += [100] * (b == len(free))
        assert offsets[i] == 100 - free[b]
        free[b] -= sizes[i]
        want[i] = b
    assert (bins == want).all()


# -- near-duplicates -----------------------------------------------------


def fingerprint(text):
    words = [w.lower() for w in (text or "").encode().split()]
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(pairs, keys):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_simhash_components(docs, empty):
    got = by_id(simhash.near_duplicates(docs))
    prints = {r[0]: fingerprint(r[1]) for r in ROWS}
    keys = sorted(prints)
    root = grouped([(a, b) for a in keys for b in keys if a < b and (prints[a] ^ prints[b]).bit_count() <= 4], keys)
    for k in keys:
        assert (got[k]["fingerprint"], got[k]["component_id"]) == (f"{prints[k]:016x}", root[k])
    assert got[None]["component_id"] == root[ROWS[0][0]]
    assert simhash.near_duplicates(empty).count() == 0


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_texts_by_brute_force(spark, docs, empty):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, rows = [word() for _ in range(150)], []
    for i in range(260):  # many near copies of one text, at all similarities
        copy = list(base)
        for _ in range(rng.randint(0, 12)):
            copy[rng.randrange(150)] = word()
        rows.append((1000 + i, "  ".join(copy).upper() if i % 7 == 0 else " ".join(copy)))
    rows += [(5, rows[3][1]), (1003, " ".join(word() for _ in range(80))), (3000, None), (3001, " "), (3002, "one two"), (3003, "One  two"), (None, rows[0][1])]
    rows += [(r[0] + 5000, r[1]) for r in ROWS]
    frame = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, mark string").repartition(3)
    named = [(k, t, shingle_set(t)) for k, t in rows if k is not None]
    near = [(i, j) for i, (_, _, a) in enumerate(named) for j, (_, _, b) in enumerate(named[:i]) if a == b or len(a & b) >= 0.8 * len(a | b)]
    root = grouped(near, range(len(named)))
    least = {}
    for i, (k, _, _) in enumerate(named):
        least[root[i]] = min(least.get(root[i], k), k)
    got = Counter((r["doc_id"], r["component_id"]) for r in near_texts.near_texts(frame).collect())
    assert got == Counter((k, least[root[i]]) for i, (k, _, _) in enumerate(named))
    left = near_texts.one_of_each(frame)
    want = [(k, t, "k") for i, (k, t, _) in enumerate(named) if k == least[root[i]]] + [(None, rows[0][1], "k")]
    assert left.columns == frame.columns and Counter(map(tuple, left.collect())) == Counter(want)
    assert near_texts.one_of_each(empty).count() == 0


def test_hot_bands_are_divided(spark, monkeypatch):
    """Near copies of one text, and a second text that only one odd copy connects: same groups, but no task has a whole band."""
    monkeypatch.setattr(near_texts, "PART", 20)
    sizes, compared = [], near_texts.compared

    def watched(rows):
        sizes.extend(r["count"] for r in rows.groupBy("bucket").count().collect())
        return compared(rows)

    monkeypatch.setattr(near_texts, "compared", watched)
    rng = random.Random(4)
    base, rows = [f"w{i}" for i in range(300)], []
    for i in range(200):
        copy = list(base)
        copy[rng.randrange(300)] = "x"
        rows.append((i, " ".join(copy)))
    got = near_texts.near_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 200 and {r["component_id"] for r in got} == {0}
    assert len(sizes) > 10 and max(sizes) <= 60


def test_large_groups_by_brute_force(spark):
    """Numbers link if they are at most 1 apart: chains over many parts, which only the meeting of strays can put together."""
    rng = random.Random(8)
    numbers = sorted(rng.sample(range(3000), 1900)) + list(range(10_000, 10_090))
    rows = [(b, n, len(numbers)) for b in (1,) for n in numbers] + [(2, n, 45) for n in range(20_000, 20_045)]
    largest = []

    def compare(frame):
        largest.append(frame.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0)
        a, b = frame.select("bucket", F.col("code").alias("a")), frame.select("bucket", F.col("code").alias("b"))
        return a.join(b, "bucket").where("a > b and a - b <= 1").select("a", "b")

    links = hot_groups.links_of_large(spark.createDataFrame(rows, "bucket bigint, code bigint, size bigint"), compare, 300)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    present, least = {n for _, n, _ in rows}, {}
    for n in sorted(present):
        least[n] = least[n - 1] if n - 1 in present else n
        assert roots.get(n, n) == least[n]
    assert max(largest) < 900


@pytest.mark.parametrize("distinct", [10, 3_000_000, 2_000_000_000])
def test_block_scheme_misses_no_pair(distinct):
    masks, rng = simhash.block_scheme(distinct), random.Random(3)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_pivot_search_connects_a_dense_group(spark):
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 2**63))
    near = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(400)}
    far = {int(x) for x in rng.integers(0, 2**63, 300)}
    prints = sorted(near | far)
    frame = spark.createDataFrame([((p + 2**63) % 2**64 - 2**63,) for p in prints], "fp bigint")
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.fingerprint_links(frame).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    want = grouped([(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 4], prints)
    assert grouped(links, prints) == want
    assert len(links) < 40 * len(prints)  # spanning links only, not all pairs


def test_components_of_a_long_chain(spark):
    order = list(range(1, 200))
    random.Random(1).shuffle(order)
    edges = [(a, b) for a, b in zip(order, order[1:])] + [(500, 501), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(1, 200), 1), 500: 500, 501: 500}


# -- substrings ----------------------------------------------------------


def removed(rows, width):
    words = [(k, (t or "").encode().split()) for k, t in rows]
    first = {}
    for k, w in words:
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            first[g] = min(first.get(g, k), k)
    out = {}
    for k, w in words:
        stay = [True] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < k:
                stay[i : i + width] = [False] * width
        out[k] = (len(w), len(w) - sum(stay), b" ".join(x for x, s in zip(w, stay) if s).decode())
    return out


@pytest.mark.parametrize("width", [3, 13, 30])
def test_substrings_by_brute_force(docs, width):
    want = removed([(2**63 - 1 if r[0] is None else r[0], r[1]) for r in docs.select("doc_id", "text").collect()], width)
    got = substring_dedup.deduplicate(docs, width, carry=("doc_id", "part", "ref")).collect()
    assert len(got) == len(ROWS) + 2
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept"]) == want[2**63 - 1 if r["doc_id"] is None else r["doc_id"]]


def test_substrings_over_many_parts(docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PART_BYTES", 700)
    monkeypatch.setattr(substring_dedup, "BUCKET_ENTRIES", 100)
    want = removed([(r[0], r[1]) for r in ROWS], 13)
    got = by_id(substring_dedup.deduplicate(docs.where("doc_id is not null")))
    assert {k: (r["n_words"], r["n_removed"], r["kept"]) for k, r in got.items()} == want


def test_substrings_of_nothing(empty):
    assert substring_dedup.deduplicate(empty).count() == 0
    assert substring_dedup.deduplicated_documents(empty).columns == empty.columns


def test_any_column_goes_through_substring_dedup(docs):
    odd = docs.select("doc_id", "text", *(F.lit(i).alias(c) for i, c in enumerate(["kept", "n_words", "n_removed", "part", "ref", "order_id", "column_1", "carry_doc_id", "a b.c"])))
    got = substring_dedup.deduplicated_documents(odd)
    want = removed([(2**63 - 1 if r[0] is None else r[0], r[1]) for r in docs.select("doc_id", "text").collect()], 13)
    assert got.columns == odd.columns
    for r in got.collect():
        n, gone, kept = want[2**63 - 1 if r["doc_id"] is None else r["doc_id"]]
        assert tuple(r)[2:] == tuple(range(9)) and (r["text"] == kept if gone else True)


def test_covers_are_difference_covers():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


# -- quality -------------------------------------------------------------


def test_statistics_by_brute_force(docs):
    got = by_id(quality_rules.document_statistics(docs))
    for key, text, *_ in ROWS:
        words = (text or "").encode().split()
        seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        want = (len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[key][s] for s in quality_rules.STATS) == want


def test_binomial_tail():
    assert quality_rules.binomial_tail(2, 5, 0.5) == pytest.approx(0.5)
    assert quality_rules.binomial_tail(0, 299, 0.01) < 0.05 < quality_rules.binomial_tail(0, 298, 0.01)


def test_groups_share_the_error():
    """Four strata of which three stand alone; the pool of the fourth takes in the smallest of them."""
    assert quality_rules.groups_of({"en": 1973, "fr": 488, "de": 475, "es": 307}) == (["en", "fr", "de"], ["es"], ["es", "de"])
    assert quality_rules.groups_of({"en": 214, "fr": 47, "de": 36, "es": 30}) == ([], ["en", "fr", "de", "es"], ["en", "fr", "de", "es"])
    assert quality_rules.groups_of({"en": 299}) == (["en"], [], []) and quality_rules.groups_of({}) == ([], [], [])
    assert quality_rules.groups_of({"a": 900, "b": 10}) == (["a"], ["b"], ["b", "a"])


def test_strata_have_cutoffs_of_their_own(spark):
    """What is usual in one language is rejected in the other."""
    text = lambda mark, n: " ".join(f"word{i}" + mark * (i < n) for i in range(60))
    rows = [(i, text("#", 30 if i % 2 else 0), "code" if i % 2 else "prose") for i in range(1000)]
    rows += [(2000, text("#", 30), "prose"), (2001, text("#", 30), "code"), (2002, text("##", 60), "code"), (2003, text("#", 30), "other")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    marks = spark.createDataFrame([(i, 1) for i in range(1000)], "doc_id bigint, quality int")
    want = {*range(1000), 2001, 2003}
    assert {r["doc_id"] for r in quality_rules.judge(frame, marks).where("kept").collect()} == want
    assert {r["doc_id"] for r in quality_rules.kept_documents(frame, marks).collect()} == want


def test_judgement(docs, labels, empty, spark):
    got = by_id(quality_rules.judge(docs, labels))
    assert all(r["kept"] == (not r["base_failed"]) for r in got.values())  # too few labels for any certificate
    assert all(r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"]) for r in got.values())
    assert quality_rules.judge(empty, labels).count() == 0
    good, bad = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}###" for i in range(60))
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3900, good).otherwise(bad).alias("text"), F.lit("en").alias("lang"))
    marks = many.select("doc_id", (F.col("doc_id") < 3900).cast("int").alias("quality"))
    assert {r["doc_id"] for r in quality_rules.judge(many, marks).where("not kept").collect()} == set(range(3900, 4000))
    assert {r["doc_id"] for r in quality_rules.kept_documents(many, marks).collect()} == set(range(3900))
    kept = quality_rules.kept_documents(docs, labels)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if got[r["doc_id"]]["kept"])


def test_small_strata_are_certified_together(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}###" for i in range(60))
    rows = [(i, good if i % 10 else bad, ("de", "fr", "es", None)[i % 4]) for i in range(350)] + [(600, bad, "unlabelled")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    marks = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(350)], "doc_id bigint, quality int")
    want = {i for i in range(350) if i % 10} | {600}  # a stratum without good labels has no cutoffs
    assert {r["doc_id"] for r in quality_rules.judge(frame, marks).where("kept").collect()} == want
    assert {r["doc_id"] for r in quality_rules.kept_documents(frame, marks).collect()} == want


def test_cutoffs_hold_their_risk():
    size = len(quality_rules.CUTOFFS)
    assert quality_rules.choose_cutoffs([366] + [0] * size, error=0.025) == {}
    assert quality_rules.choose_cutoffs([368] + [0] * size, error=0.025)["symbols"] == quality_rules.CUTOFFS[-1]
    counts = [980] + [0] * size
    counts[20] = 20  # 2 % are rejected from the 29th step on
    assert quality_rules.choose_cutoffs(counts, error=0.025)["symbols"] == quality_rules.CUTOFFS[27]


def test_network_learns_and_scores_whole_texts(docs, labels, empty):
    rng = random.Random(1)
    good = ["".join(rng.choice("abcdefg ") for _ in range(rng.randint(30, 1500))) for _ in range(80)]
    bad = [t[: len(t) // 2] + "###!!" + t[len(t) // 2 :] for t in good]
    net = conv_quality.ConvNet().fit([t.encode() for t in good[:60] + bad[:60]], np.array([1] * 60 + [0] * 60), epochs=12).freeze()
    scores = net.scores([t.encode() for t in good[60:] + bad[60:]])
    assert ((scores > 0.5) == ([True] * 20 + [False] * 20)).mean() > 0.9
    alone = np.concatenate([net.scores([t.encode()]) for t in good[60:]])
    assert np.allclose(alone, scores[:20], atol=1e-5)  # a text's score doesn't depend on its batch
    got = by_id(conv_quality.classify(docs, labels))
    assert len(got) == len(ROWS) + 1 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items() if k is not None)
    assert conv_quality.classify(docs, labels.limit(0)).where("score between 0 and 1").count() == len(ROWS) + 2
    assert conv_quality.classify(empty, labels).count() == 0 == conv_quality.kept_documents(empty, labels).count()
    assert sorted(str(r["doc_id"]) for r in conv_quality.kept_documents(docs, labels).collect()) == sorted(str(r["doc_id"]) for r in conv_quality.classify(docs, labels).where("predicted = 1").collect())


def test_network_is_held_to_rows_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    figures = conv_quality.held_out_figures(conv_quality.classify(docs, labels), labels)
    assert figures["rows"] > 50 and figures["auc"] >= 0.95 and figures["accuracy"] >= 0.85


def test_training_takes_whole_texts_and_is_bounded(spark):
    long = "".join(chr(97 + i % 26) for i in range(400_000))
    rows = [(i, long if i == 1 else f"text {i}") for i in range(400)] + [(2, "again"), (None, "x")]
    frame = spark.createDataFrame([(*r, 5, "p") for r in rows], "doc_id bigint, text string, quality int, place string")
    marks = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)] + [(1, 1), (3, 0)], "doc_id bigint, quality int")
    got, odds = conv_quality.training_rows(frame, marks, 30, 10**9, "doc_id", "text")
    learnt = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    good = [i for i in learnt if i % 4 and i != 3]
    again = int(2 in learnt)
    assert odds == {1: len(good) + again, 0: len(learnt) - len(good)}  # an id with two labels has the least
    texts = {t.encode() for _, t in rows}
    assert Counter(y for y, _ in got) == {0: 30, 1: 30} and all(b in texts for _, b in got)
    assert got == conv_quality.training_rows(frame.repartition(7).unionAll(frame), marks, 30, 10**9, "doc_id", "text")[0]  # repeats are learnt once
    every = conv_quality.training_rows(frame, marks, 1000, 10**9, "doc_id", "text")[0]
    assert (1, long.encode()) in every and len(every) == sum(odds.values())
    few = conv_quality.training_rows(frame, marks, 1000, 100, "doc_id", "text")[0]
    assert all(sum(len(b) for y, b in few if y == label) <= max(100, max(len(b) for y, b in few if y == label)) for label in (0, 1)) and len({y for y, _ in few}) == 2


def test_gradients_of_blocks_equal_those_at_once():
    net, rng = conv_quality.ConvNet(), random.Random(6)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (5, 30_000, 700)]
    once, blocks = (net.gradients(texts, np.array([0, 1, 1]), np.ones(2), block=n) for n in (10**6, 7))
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(once, blocks))


def test_network_equals_direct_convolution():
    net = conv_quality.ConvNet().freeze()
    for text in (b"", b"x", b"short", bytes(random.Random(3).randrange(256) for _ in range(1700))):
        padded = np.frombuffer((text or b"\0") + b"\0" * (conv_quality.WIDTH - 1), np.uint8)
        act = np.array([sum(net.w[j][padded[p + j]] for j in range(conv_quality.WIDTH)) for p in range(max(1, len(text)))]) + net.b
        pooled = np.array([np.maximum(act[i : i + conv_quality.CHUNK].max(axis=0), 0) for i in range(0, len(act), conv_quality.CHUNK)])
        logit = np.concatenate([pooled.max(axis=0), pooled.mean(axis=0)]) @ net.v + net.c[0]
        assert net.scores([text])[0] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-5)


def test_language_model_by_brute_force(docs, labels, empty):
    got = by_id(lm_scores.score_documents(docs, labels))
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    start = object()
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in docs.select("doc_id", "text").collect()]
    rows = [(k, list(zip(words, [start, *words], zip([start, *words], words)))) for k, words in rows]
    models = []
    for keep in (lambda k: k in good, lambda k: True):
        words, pairs = Counter(), Counter()
        for k, tokens in rows:
            if keep(k) and tokens:
                words.update([*(w for w, _, _ in tokens), tokens[0][1]])
                pairs.update(p for _, _, p in tokens)
        models.append((words, pairs, sum(words.values())))
    for k, tokens in rows:
        if not tokens:
            assert (got[k]["n_tokens"], got[k]["score"]) == (0, 0.0)
            continue
        want = []
        for words, pairs, total in models:
            single = lambda w: (words[w] + lm_scores.FLOOR) / (total + lm_scores.FLOOR * 2**lm_scores.WORD_BITS)  # noqa: E731, B023
            want.append(np.mean([-np.log((pairs[p] + lm_scores.BACKOFF * single(w)) / (words[b] + lm_scores.BACKOFF)) for w, b, p in tokens]))
        assert got[k]["n_tokens"] == len(tokens) and [got[k]["target_loss"], got[k]["background_loss"]] == pytest.approx(want, rel=1e-4)
        assert got[k]["score"] == pytest.approx(want[0] - want[1], abs=1e-5)
    assert lm_scores.score_documents(empty, labels).count() == 0


def test_language_model_counts_are_exact_at_any_size(spark, monkeypatch):
    """Rare words and pairs stay apart however many there are; slots of fixed tables would share them."""
    rng = random.Random(6)
    texts = ["".join(f"w{rng.randrange(10**9)} " for _ in range(2000)) + "same pair" for _ in range(1200)] + ["same pair", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    marks = spark.createDataFrame([(i, 1, 0) for i in range(0, 1200, 3)], "doc_id bigint, quality int, toxic int")
    monkeypatch.setattr(lm_scores, "BUCKET_KEYS", 50_000)
    monkeypatch.setattr(lm_scores, "SLICE_BYTES", 3_000_000)
    got = by_id(lm_scores.score_documents(frame, marks))
    models = []
    for own in (texts[:1200:3], texts):
        words, pairs = Counter(), Counter()
        for t in own:
            tokens = (t or "").split()
            words.update(["", *tokens] if tokens else [])
            pairs.update(zip(["", *tokens], tokens))
        models.append((words, pairs, sum(words.values())))
    vocabulary = len(models[1][0])
    assert vocabulary > 2**lm_scores.WORD_BITS  # the uniform distribution covers all words
    for k in (0, 1, 600, 1200):
        tokens = texts[k].split()
        want = [np.mean([-np.log((pairs[b, w] + lm_scores.BACKOFF * (words[w] + lm_scores.FLOOR) / (total + lm_scores.FLOOR * vocabulary)) / (words[b] + lm_scores.BACKOFF)) for b, w in zip(["", *tokens], tokens)]) for words, pairs, total in models]
        assert [got[k]["target_loss"], got[k]["background_loss"]] == pytest.approx(want, rel=1e-9)
    assert len(got) == len(texts) and got[1201]["n_tokens"] == 0


# -- urls ----------------------------------------------------------------


def test_urls(spark):
    urls = {
        "HTTP://WWW.Shop.COM/en/7?x#y": ("www.shop.com", "/en/7", "com/en/", "block"),
        "http://a.example.com/en/71": ("a.example.com", "/en/71", "example.com/en/7", "allow"),
        "x://example.net/de/8/": ("example.net", "/de/8/", "example.net/de/8", "block"),
        "x://other.net/de/8": ("other.net", "/de/8", "net/de/", "allow"),
        "https://bad.org/es/": ("bad.org", "/es/", "org/es/", "block"),
        "https://notcom/en/": ("notcom", "/en/", None, None),
        "https://ÀB.com?/en/": ("Àb.com", "", None, None),
        "https://casino-bonus.fr/free-spins": ("casino-bonus.fr", "/free-spins", None, "block"),
        "https://www.library.fr/guide/install": ("www.library.fr", "/guide/install", None, "allow"),
        "no scheme": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
    }
    urls["x://other.net/de/8"] = ("other.net", "/de/8", "net/de/", "block")
    frame = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] * 2, "page_id bigint, url string, host string")
    got = url_filter.judge(frame).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        host, path, rule, verdict = list(urls.values())[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and verdict in (None, r["verdict"]) and (r["score"] is None) == (rule is not None)
    assert url_filter.judge(frame.limit(0)).count() == 0
    own = spark.createDataFrame([("http://x.fr/aaa", 1), ("http://y.fr/zzz", 0), (None, 1)], "url string, label int")
    learnt = url_filter.judge(spark.createDataFrame([(1, "http://z.fr/aaaa"), (2, "http://z.fr/zzzz")], "page_id bigint, url string"), url_filter.train_table(own))
    assert [r["verdict"] for r in learnt.orderBy("page_id").collect()] == ["block", "allow"]
    with pytest.raises(ValueError):
        url_filter.train_table(own, most=1)


def test_rules_say_what_the_contract_says(spark, tmp_path):
    says = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {d + p: v for v, d, p in url_filter.RULES} == says
    urls = {
        "http://a.com/en/": "com/en/",
        "http://example.com/en/8": "com/en/",
        "http://www.example.com/en/71": "example.com/en/7",
        "http://net/de/": "net/de/",
        "http://casino-bonus.net/de/8": "net/de/",  # the rule decides, whatever the model would say
        "http://m.example.net/de/7": "net/de/",
        "http://example.net/de/8": "example.net/de/8",
        "http://m.example.net/de/81?x": "example.net/de/8",
        "http://a.b.org/es/": "org/es/",
    }
    spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = queries.op4_url_filter(spark, str(tmp_path)).collect()
    assert {(r["page_id"], r["rule"], r["verdict"]) for r in rows} == {(i, rule, says[rule]) for i, rule in enumerate(urls.values())}


def parsed(url):
    """An independent reading of host, path and the fitting rule."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url[url.index("://") + 3 :]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [d + p for _, d, p in url_filter.RULES if (host.split(".")[-d.count(".") - 1 :] == d.split(".")) and path[: len(p)] == p]
    return host, path, max(fits, key=len, default=None)


def test_random_urls_by_an_independent_parser(spark):
    rng = random.Random(17)
    pieces = ["http", "://", "://", "/", "?", "#", ".", "www", "example", ".com", ".net", ".org", "com", "/en/", "/de/", "/es/", "7", "8", "É", "Xy", ":80", "@", " "]
    urls = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(1500)]
    urls += [f"{a}://{h}{p}" for a in ("http", "") for h in ("example.com", "a.EXAMPLE.com", "notexample.com", "example.net", "x.org", "com", "") for p in ("", "/en/7", "/en/71?x", "/de/8", "/es/#", "/en")] + [None]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    says = {d + p: v for v, d, p in url_filter.RULES}
    model = url_filter.train()
    for r in url_filter.judge(frame, model).collect():
        host, path, rule = parsed(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        logit = model.logits([f"{host}{path}".encode()])[0]
        assert r["verdict"] == (says[rule] if rule else "block" if logit >= 0 else "allow")


def test_regression_separates_held_out_urls():
    def figures(learnt, unseen):
        model = url_filter.train(learnt)
        keys = [url_filter.key_of(*parsed(u)[:2]) for u, _ in unseen]
        scores, y = model.logits(keys), np.array([k for _, k in unseen])
        bad, good = scores[y == 1], scores[y == 0]
        return (bad[:, None] > good[None]).mean(), ((scores >= 0) == y).mean()

    auc, accuracy = figures(url_table.labelled_urls(), url_table.labelled_urls(600, seed=99))
    assert auc >= 0.98 and accuracy >= 0.95
    auc, _ = figures(url_table.labelled_urls(bad=url_table.BAD[::2], good=url_table.GOOD[::2]), url_table.labelled_urls(600, 99, url_table.BAD[1::2], url_table.GOOD[1::2]))
    assert 0.6 < auc < 0.95  # words that were never seen can't be known


def test_url_scores_do_not_depend_on_their_batch():
    model, rng = url_filter.train(), random.Random(8)
    texts = [b"", *(f"site{rng.randrange(999)}.fr/{'casino-bonus/free' if i % 3 else 'guide/'}{rng.randrange(99)}".encode() for i in range(200)), b"", b"x"]
    alone = [model.logits([t])[0] for t in texts]
    assert model.logits(texts) == pytest.approx(alone, abs=1e-12)
    assert model.logits(texts[::-1])[::-1] == pytest.approx(alone, abs=1e-12)


# -- neighbours ----------------------------------------------------------


def exact(rows, queries, top):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        score = x @ x[np.flatnonzero(ids == q)[0]]
        order = [i for i in np.lexsort((ids, -np.round(score, 9))) if ids[i] != q]
        out[q] = [int(ids[i]) for i in order[:top]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.6 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(10_000 + i, rows[50][1]) for i in range(40)]  # equal vectors: ties go to the smaller id
    odd = [(20_000, None), (20_050, [0.0] * 16), (20_100, [float("nan")] + [1.0] * 15), (20_150, [None] + [1.0] * 15), (20_200, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (20_250, [1.0])]
    frame = spark.createDataFrame([(a, b, "x") for a, b in rows + odd + rows[:1]], "vec_id bigint, embedding array<float>, node string")
    got = {}
    for r in nn_descent.nearest(frame, F.col("query_id") % 50 == 0, part_nodes=700, leaf=256, trees=2, k=16, listed=12).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = exact(rows, [r[0] for r in rows if r[0] % 50 == 0], 5)
    assert got.keys() == want.keys() and all(sorted(v) == [1, 2, 3, 4, 5] for v in got.values())
    hits = np.mean([len({v[0] for v in got[q].values()} & set(w)) / 5 for q, w in want.items()])
    assert hits >= 0.95
    assert [got[50][i][0] for i in range(1, 6)] == [10_000, 10_001, 10_002, 10_003, 10_004] and got[50][1][1] == pytest.approx(1)
    assert [got[10_000][i][0] for i in range(1, 6)] == [50, 10_001, 10_002, 10_003, 10_004]


def test_planes_are_fitted_some_levels_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "STEP", 2)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 12))
    rows = [(i, (centres[i % 40] + 0.5 * rng.normal(size=12)).tolist()) for i in range(2400)]
    rows += [(3000 + i, (centres[0] + 1e-7 * rng.normal(size=12)).tolist()) for i in range(600)]  # one vector in bytes
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    nodes = frame.toDF("node", "vector")
    blocks, made = nn_descent.blocks_of(nn_descent.node_vectors(nodes, 12, 4), 3000, 12, 150, 2)
    assert len(made) == 5  # planes of three steps, and blocks put together between them
    found = {}
    for r in blocks.collect():
        found.setdefault(r["part"], []).extend(nn_descent.unpacked(r["ids"]).tolist())
    for tree in (0, 1):
        own = [x for p, x in found.items() if p % 2 == tree]
        assert sorted(sum(own, [])) == [r[0] for r in rows]
        assert max(map(len, own)) < 450 and len(own) > 16  # equal bytes are dealt to both sides of a plane
    got = {}
    for r in nn_descent.nearest(frame, F.col("query_id") % 50 == 0, block=150, leaf=64, part_nodes=700).where("query_id < 3000").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = exact(rows, [r[0] for r in rows if r[0] % 50 == 0 and r[0] < 2400], 5)
    assert np.mean([len(got[q] & set(w)) / 5 for q, w in want.items() if q % 40]) >= 0.9


def test_few_or_no_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, -1.0])], "vec_id bigint, embedding array<float>")
    got = nn_descent.nearest(frame, F.col("query_id") % 50 == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 1), (2, 2)] and got[0]["score"] == pytest.approx(0.5**0.5)
    assert nn_descent.nearest(frame.limit(0), F.lit(True)).count() == 0


def test_one_id_with_several_vectors_is_answered_once(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, (x[0] + 0.001 * rng.normal(size=4)).tolist()) for _ in range(6)] + [(100, [1e200, -1e200, 3e199, 0.0]), (101, [1e-200, 2e-200, 0.0, 0.0]), (150, [1.0, 2.0]), (151, [2.0, 4.1])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in nn_descent.nearest(frame, F.col("query_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    scale = lambda v: np.array(v) / np.abs(v).max()
    cos = lambda a, b: scale(a) @ scale(b) / np.linalg.norm(scale(a)) / np.linalg.norm(scale(b))
    for q in (0, 100):
        best = {}
        for k, v in rows[:-2]:
            if k != q:
                best[k] = max(best.get(k, -2), cos(dict(rows)[q], v))
        want = sorted(best, key=lambda k: (-round(best[k], 12), k))[:5]
        assert [k for k, _ in got[q]] == want and [s for _, s in got[q]] == pytest.approx([best[k] for k in want], rel=1e-12)
    assert [k for k, _ in got[150]] == [151]  # only vectors of the same length


def test_components_stay_whole_where_one_holds_all(spark):
    edges = spark.range(1, 3000).selectExpr("id as a", "0L as b")
    assert components(edges).where("root = 0").count() == 3000


# -- queries and the pipeline ------------------------------------------------


@pytest.fixture(scope="module")
def folder(docs, labels, spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    docs.select("doc_id", "text", "lang").where("doc_id is not null").distinct().write.parquet(str(base / "documents.parquet"))
    labels.write.parquet(str(base / "labels.parquet"))
    spark.createDataFrame([(1, "http://a.com/en/"), (2, "http://casino-bonus.fr/spam"), (3, None)], "page_id bigint, url string").write.parquet(str(base / "pages.parquet"))
    rng = np.random.default_rng(0)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(120, 8)))], "vec_id bigint, embedding array<float>").write.parquet(str(base / "embeddings.parquet"))
    return str(base)


COLUMNS = {
    "op1_simhash": "doc_id fingerprint component_id",
    "op2_lm_scores": "doc_id n_tokens target_loss background_loss score",
    "op3_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op4_url_filter": "page_id host path rule verdict",
    "op5_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op6_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op7_bpe_codec": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op8_conv_quality": "doc_id held_out score predicted",
    "op9_nn_descent": "query_id rank vec_id score",
    "op10_token_counts": "doc_id n_bytes n_tokens over_limit",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_every_query_runs_over_its_whole_table(name, folder, spark):
    got = queries.QUERIES[name](spark, folder)
    assert got.columns == COLUMNS[name].split()
    rows = got.collect()
    if name == "op9_nn_descent":
        assert Counter(r["query_id"] for r in rows) == {0: 5, 50: 5, 100: 5}
    elif name == "op4_url_filter":
        assert [(r["page_id"], r["rule"], r["verdict"]) for r in sorted(rows)][:2] == [(1, "com/en/", "block"), (2, None, "block")]
        assert rows[2]["verdict"] in ("allow", "block") and (rows[2]["host"], rows[2]["path"]) == ("", "")
    else:
        assert {r["doc_id"] for r in rows} == {r[0] for r in ROWS} and (name == "op5_packing" or len(rows) == len(ROWS))


def test_digest_queries_match_operators(folder, spark):
    got = by_id(queries.op3_substring_dedup(spark, folder))
    for k, (n, gone, kept) in removed([(r[0], r[1]) for r in ROWS], 13).items():
        assert (got[k]["n_words"], got[k]["n_removed"], got[k]["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
    coded, sizes = by_id(queries.op7_bpe_codec(spark, folder)), by_id(queries.op10_token_counts(spark, folder))
    for k, text, *_ in ROWS:
        assert coded[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids(text))).encode()).hexdigest() and coded[k]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
        assert sizes[k]["n_tokens"] == coded[k]["n_tokens"] == len(ids(text))
    for r in queries.op5_packing(spark, folder).collect():
        own = [*ids(dict((k, t) for k, t, *_ in ROWS)[r["doc_id"]]), 0]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())


NAMES = "kept n_words n_removed part ref hashes quality place code mark fp bands bucket size gone_id one words root least stratum held_out score start length sequence_id column_0 limits".split()


def test_pipeline_stage_by_stage(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    shared = [word() for _ in range(60)]
    texts = [" ".join(word() for _ in range(rng.randint(60, 150))) for _ in range(400)]
    for i in range(0, 400, 10):  # a passage, near copies, exact copies, bad texts
        texts[i] = f"{texts[i]} {' '.join(shared)} {texts[i]}x"[: 2000]
        texts[i + 1] = texts[i + 2].replace(" ", "  ", 1)
        words = texts[i + 3].split()
        words[len(words) // 2] = "changed"
        texts[i + 4] = " ".join(words)
        texts[i + 5] = " ".join(w + "##$%" for w in texts[i + 5].split())
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[8]), (500, None), (501, ""), (502, "short one"), (8, " ".join(word() for _ in range(90)))]
    extra = ", ".join(f"{c} int" for c in NAMES)
    frame = spark.createDataFrame([(k, t, "en", "s", len(t or ""), *range(len(NAMES))) for k, t in rows], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}")
    marks = spark.createDataFrame([(i, int(i % 10 != 5), 0) for i in range(400)], "doc_id bigint, quality int, toxic int")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    plain = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    stages, docs, seen = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{d}/documents.parquet"), []
    for name in ("quality_rules", "quality_classifier", "near_dedup", "substring_dedup"):
        docs = common.cut(stages[name](spark, docs, d), "test-stage")
        assert docs.columns == frame.columns and all(tuple(r)[5:] == tuple(range(len(NAMES))) for r in docs.collect())
        seen.append(plain(docs))
    bad = {i for i in range(400) if i % 10 == 5}
    good = [(k, t) for k, t in rows if k not in bad and len((t or "").split()) >= 50]
    assert seen[0] == sorted([r for r in good if 2 * quality_rules.statistics_of(r[1])[4] <= len(r[1].split())], key=str)
    assert set(seen[1]) <= set(seen[0]) and len(seen[1]) >= 0.9 * len(seen[0])
    sets = [(k, t, shingle_set(t)) for k, t in seen[1] if k is not None]
    root = grouped([(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a[2] & b[2]) >= 0.8 * len(a[2] | b[2])], range(len(sets)))
    least = {}
    for i, (k, _, _) in enumerate(sets):
        least[root[i]] = min(least.get(root[i], k), k)
    assert seen[2] == sorted([(k, t) for i, (k, t, _) in enumerate(sets) if k == least[root[i]]] + [r for r in seen[1] if r[0] is None], key=str)
    words = removed_rows(seen[2], 13)
    assert seen[3] == sorted(words, key=str)
    before = len(common.WRITTEN)
    spans = corpus_pipeline.run(spark, d).collect()
    assert len(common.WRITTEN) == before + 1  # only the last stage's rows are left
    want = Counter((k, zlib.crc32(np.array([*ids(t), 0][i : i + 1024], "<u4").tobytes())) for k, t in seen[3] for i in range(0, len(ids(t)) + 1, 1024))
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in spans) == want
    spark.createDataFrame([], frame.schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    marks.limit(0).write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, f"{d}/none").count() == 0


def removed_rows(rows, width):
    """As ``removed``, for rows that may repeat ids; texts that lose nothing stay as they are."""
    order = lambda k: 2**63 if k is None else k
    first, out = {}, []
    for k, t in rows:
        w = t.split()
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            first[g] = min(first.get(g, order(k)), order(k))
    for k, t in rows:
        w = t.split()
        stay = [True] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < order(k):
                stay[i : i + width] = [False] * width
        out.append((k, t if all(stay) else " ".join(x for x, s in zip(w, stay) if s)))
    return out


def test_quality_rules_query_equals_its_sql(spark):
    import duckdb

    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    want = con.sql(queries.ORACLE_SQL["op6_quality_rules"])
    got = queries.QUERIES["op6_quality_rules"](spark, sf_dir).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
