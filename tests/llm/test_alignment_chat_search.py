"""Token alignment, chat formatting and lexical search against brute-force versions, with nulls, long texts, ties and clashing columns."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from kelpline.llm import chat_format, lexical_search, queries, token_alignment
from kelpline.llm.bytebpe import byte_alphabet
from kelpline.llm.queries import PIECES, TOKENIZER

EXTRA = "doc_id bigint, text string, lang string, item_id int, part int, score string, _id int"
A = Tokenizer.from_file(TOKENIZER)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PIECES)
OF_CHAR = byte_alphabet()


def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["tion", "er", "ou", "é", "中", "ß", "x1", "-"]) for _ in range(rng.randint(1, 4)))
    plain = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(25)]
    odd = [None, "", " ", "a", "  two  blanks ", "tab\tand\n\nlines \n x", "</s> <s> <|endoftext|> [INST]", "▁ is a blank", "a\x00b c", "ｆｕｌｌ width", "é x", "　wide blank　", "x" * 700, "🙂🙂 🙂", "don't we'll I'M", "\x1c odd \x1d space"]
    long_ = [" ".join(word() for _ in range(900)), "ou" * 900 + " " + " ".join(word() for _ in range(200)), "  \n" * 300 + "end", " ".join(word() for _ in range(400)) + " ▁ " + " ".join(word() for _ in range(400))]
    return plain + odd + long_ + plain[:3]


TEXTS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(3 * i, t, "en", i, 1, "s", 4) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[2], (None, "null id", "en", 1, 1, "s", 4)], EXTRA).repartition(3).cache()


# -- alignment -----------------------------------------------------------


def tokens_of(text):
    a = A.encode(" " + text, add_special_tokens=False)
    b = B.encode(text)
    a_bytes = [bytes(OF_CHAR[c] for c in t) for t in a.tokens]
    b_bytes = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    return a.ids, a_bytes, b, b_bytes


def groups_of(text):
    if not text:
        return None
    a, a_bytes, b, b_bytes = tokens_of(text)
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return None
    a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
    common = sorted(set(a_ends) & set(b_ends))
    out, i, j = [], 0, 0
    for e in common:
        m, n = a_ends.index(e) + 1, b_ends.index(e) + 1
        out.append((a[i:m], b[j:n]))
        i, j = m, n
    return out


def brute_alignment(all_texts):
    found = [groups_of(t) for t in all_texts]
    counts = Counter((g[0][-1], g[1][-1]) for groups in found if groups for g in groups)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    rows = []
    for groups in found:
        if not groups:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        rows.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), text))
    return rows


@pytest.mark.parametrize("chunk", [token_alignment.CHUNK, 100, 37])
def test_alignment_equals_brute_force(docs, chunk):
    """Small chunks send most texts through fragments; their ends fall into words, stretches without blanks and characters of several bytes."""
    held = docs.select("doc_id", "text").collect()
    want = Counter(zip((r["doc_id"] for r in held), brute_alignment([r["text"] for r in held])))
    got = token_alignment.align(docs, TOKENIZER, PIECES, chunk=chunk, fan=3).collect()
    assert Counter((r["doc_id"], tuple(r)[1:]) for r in got) == want


def test_alignment_digests_and_empty_tables(docs):
    text = {r["doc_id"]: r["groups"] for r in token_alignment.align(docs, TOKENIZER, PIECES).collect()}
    shown = {r["doc_id"]: r["groups_sha256"] for r in token_alignment.align(docs, TOKENIZER, PIECES, digest=True).collect()}
    assert shown == {k: hashlib.sha256(t.encode()).hexdigest() if t else "" for k, t in text.items()}
    assert token_alignment.align(docs.limit(0), TOKENIZER, PIECES).count() == 0


def test_fragments_are_a_monoid():
    """However the token stream is cut and whichever neighbours are put together first, the whole is the same."""
    both, rng = token_alignment.aligner(TOKENIZER, PIECES), random.Random(3)
    for text in [" " + t for t in TEXTS if t and groups_of(t) and len(t) > 40][:12]:
        a, a_ends, b, b_ends, *_ = both.tokens(token_alignment.pieces_of(text))
        n = int(a_ends[-1])
        cuts = [0, *sorted(rng.sample(range(1, n), min(9, n - 1))), n]
        parts = []
        for lo, hi in zip(cuts, cuts[1:]):
            x, y = (a_ends > lo) & (a_ends <= hi), (b_ends > lo) & (b_ends <= hi)
            parts.append(token_alignment.of_tokens(both, a[x], a_ends[x], b[y], b_ends[y]))
        seen = set()
        for _ in range(6):
            left = list(parts)
            while len(left) > 1:
                i = rng.randrange(len(left) - 1)
                left[i : i + 2] = [token_alignment.compose(both, left[i], left[i + 1])]
            seen.add(token_alignment.whole(both, token_alignment.compose(both, token_alignment.EMPTY, left[0]), False))
        assert len(seen) == 1
        want = groups_of(text[1:])
        assert seen.pop()[2] == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in want)


def test_ranges_cover_texts():
    for text in [" " + t for t in TEXTS if t]:
        for chunk in (5, 64):
            held = [w.encode()[lo:hi] for w, lo, hi in token_alignment.ranges_of(text, chunk)]
            assert b"".join(held) == text.encode()


def test_pairs_are_bounded(docs):
    most = token_alignment.most_pairs(TOKENIZER, PIECES)
    assert most < 2_000_000
    pairs = {(g[0][-1], g[1][-1]) for t in TEXTS for g in groups_of(t) or []}
    assert len(pairs) < most


# -- chat ----------------------------------------------------------------

TALKS = "conv_id bigint, turn int, role string, text string, part int, state string, segments string"


def talks():
    rng = random.Random(2)
    rows = []
    for c in range(30):
        roles = (["system"] if c % 3 == 0 else []) + ["user", "assistant"] * rng.randint(1, 4)
        rows += [(c, t, role, " ".join(rng.choice(["a", "[INST]", "</s>", "\\", "<<SYS>>", "é\n", "[/INST", "<s", "[[INST]]"]) for _ in range(rng.randint(0, 12)))) for t, role in enumerate(roles)]
    rows += [(100, 0, "assistant", "first"), (100, 1, "user", None), (100, 1, "user", "tie"), (101, 0, None, "no role"), (101, 1, "tool [/ROLE]", "x [/TURN] \\"), (101, None, "user", "null turn"), (None, 0, "user", "no id"), (None, 1, "assistant", "")]
    rows += [(50, t, ("user", "assistant")[t % 2], f"text {t} [OUT]") for t in range(400)]  # one long conversation
    rows += [(51, t, "critic", f"only {t}") for t in range(60)] + [(51, 60, "user", "at last")]
    return [(*r, 1, "s", "x") for r in [*rows, rows[3]]]


def brute_talks(rows):
    by = defaultdict(list)
    for c, t, role, text, *_ in rows:
        by[c].append((t, role, text))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
        said = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in turns)
        loss = "".join(text or "" for _, role, text in turns if role == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("size", [chat_format.PIECE_CHARS, 60])
def test_chat_is_read_back(spark, size):
    rows = talks()
    df = spark.createDataFrame(rows, TALKS).repartition(5)
    formatted = chat_format.format_conversations(df, piece_chars=size).cache()
    got = {r["conv_id"]: r for r in chat_format.read_digests(formatted).collect()}
    want = brute_talks(rows)
    assert set(got) == set(want)
    for c, (n, turns, chars, loss) in want.items():
        r = got[c]
        if c != 100:  # ties of turn and role have an order of their own
            assert r["turns_sha256"] == turns, c
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (n, chars, loss), c
    pieces = formatted.orderBy("conv_id", "part").collect()
    whole = defaultdict(list)
    for r in pieces:
        whole[r["conv_id"]] += r["segments"]
    for c, segments in whole.items():
        text = "".join(s["text"] for s in segments)
        assert len(text) == got[c]["formatted_chars"]
        assert text.count("<s>") == 1 and text.startswith("<s>")  # once, also where a conversation has many pieces
    wrong = {r["conv_id"]: r["n_wrong"] for r in chat_format.read_digests(formatted).collect()}
    assert wrong[0] == 0 and wrong[50] == 0 and wrong[100] == 2 and wrong[51] == 61 and wrong[None] == 0
    if size == 60:
        assert sum(r["conv_id"] == 50 for r in pieces) > 20


def test_chat_controls_only_where_the_template_puts_them():
    t = chat_format.TEMPLATE
    for text in ("<s><s>", "[INST] [/INST] [[INST]", "\\[INST]\\.", "<<<SYS>>>", "</s></s", ""):
        assert not any(c in t.escape(text) for c in t.controls)
        assert t.unescape(t.escape(text)) == text
    with pytest.raises(ValueError):
        chat_format.Template({"user": chat_format.Turn(("start",), "<u>", " </u>", False, "asked")}, ("<u>", "</u>"))


def test_chat_of_nothing(spark):
    empty = spark.createDataFrame([], TALKS)
    assert chat_format.read_digests(chat_format.format_conversations(empty)).count() == 0


# -- search --------------------------------------------------------------


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute_search(rows, items, k):
    held = [(key, Counter(terms(text))) for key, text in rows]
    held = [(key, c, sum(c.values())) for key, c in held if c]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for key, c, n in held:
            m = 25 + 75 * n * n_docs // total
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if c[t])
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, key, -s) for i, (s, _, _, key) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return Counter(out)


def search_corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 80)))) for i in range(600)]
    rows += [(1000 + i, "Äpfel w299 É W298 w1") for i in range(15)] + [(700, None), (701, ""), (702, "?! \n"), (None, "w299 w299"), (5, rows[5][1]), (703, "w0 " * 30_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(40)] + [(50, "w0 w0 w1"), (51, None), (52, "nowhere"), (53, "äpfel Äpfel w299"), (54, "w299 W299 w299"), (55, " ".join(words))]
    return rows, items


@pytest.mark.parametrize("shard", [lexical_search.SHARD_BYTES, 4_000, 20_000])
def test_search_equals_brute_force(spark, shard):
    rows, items = search_corpus()
    df = spark.createDataFrame([(a, b, "en", 1, 1, "s", 2) for a, b in rows], EXTRA).repartition(4)
    asked = spark.createDataFrame([(a, b, 3) for a, b in items], "item_id int, text string, doc_id int")
    got = lexical_search.search(df, asked, shard_bytes=shard).collect()
    assert Counter(map(tuple, got)) == brute_search(rows, items, 10)


@pytest.mark.parametrize("short,size", [(0, 3), (10, 16), (10**9, 50)])
def test_search_of_a_shard_skips_nothing_needed(short, size):
    rng = np.random.default_rng(4)
    for _ in range(20):
        n, n_terms = int(rng.integers(1, 200)), 12
        sets = [np.sort(rng.choice(n, int(rng.integers(1, n + 1)), replace=False)) for _ in range(n_terms)]
        dfs = np.array([len(s) for s in sets])
        lengths = rng.integers(1, 50, n)
        shard = lexical_search.Shard(lengths, np.arange(n_terms), dfs, np.concatenate(sets), rng.integers(1, 5, dfs.sum()), 1000, 20_000)
        weights = rng.integers(0, 6, n_terms) * rng.integers(1, 400, n_terms)
        best = lexical_search.Best(5)
        lexical_search.search_shard(shard, list(range(n)), np.arange(n_terms), weights, best, short, size)
        full = np.zeros(n, np.int64)
        for t in range(n_terms):
            docs, gains = shard.list_of(t)
            full[docs] += gains * weights[t]
        want = sorted(((-int(s), i) for i, s in enumerate(full) if s > 0))[:5]
        assert sorted((-s, r.key) for s, r, _ in best.heap) == want


def test_search_in_blocks_and_of_nothing(spark):
    rows, items = search_corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    asked = spark.createDataFrame(items, "item_id int, text string")
    assert Counter(map(tuple, lexical_search.search(df, asked, k=3, block_chars=900).collect())) == brute_search(rows, items, 3)
    assert lexical_search.search(df.limit(0), asked).count() == 0
    assert lexical_search.search(df, asked.limit(0)).count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_on_the_tables(spark):
    import duckdb
    import pyarrow.parquet as pq

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = Counter(tuple(r) for r in queries.op13_lexical_search(spark, SF).collect())
    assert got == Counter(con.execute(queries.ORACLE_SQL["op13_lexical_search"]).fetchall())

    talks_ = pq.read_table(f"{SF}/conversations.parquet").to_pydict()
    rows = list(zip(*(talks_[c] for c in ("conv_id", "turn", "role", "text")))) + [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: tuple(r)[1:5] for r in queries.op12_chat_format(spark, SF).collect()}
    assert got == brute_talks(rows)

    held = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    want = brute_alignment(held["text"])
    want = Counter((k, *r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for k, r in zip(held["doc_id"], want))
    assert Counter(map(tuple, queries.op11_token_alignment(spark, SF).collect())) == want
