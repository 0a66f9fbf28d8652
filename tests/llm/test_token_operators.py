"""Packing, token files, sharding, personal data, chat formatting."""

import random
import zlib
from collections import Counter, defaultdict


import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from freshet.llm import chat_format, packing, pii, sharding, token_store
from freshet.llm.common import scratch
from freshet.llm.queries import tokenizer_file
from freshet.llm.tokenization import SpacedPieces, WordPieces

from . import brute

ODD = ["", " ", "\n", " a", "a ", "a  b", "it's don't I'll HE'S we've", "x\ty", "ÉCOLE Straße İstanbul ǅ ﬁ x²", "Hello, world!! foo.", "日本語 text", "a,b c.d ...", "<|endoftext|> x", "é café", "\x00a b", "1234 12.5, 3rd", "foo\nBar baz.\nQux", "end.\n", "a\x1cb \x85c", "word' s", "KK ª º µ", "́x", "a" * 5000, "😀 \U0001f9ea!"]


@pytest.fixture(scope="module")
def rows():
    return brute.corpus(2)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return brute.frame(spark, rows).repartition(3)


@pytest.mark.parametrize(("kind", "name"), [(WordPieces, "word_bpe_49k.json"), (SpacedPieces, "byte_bpe_50k.json")])
def test_pieces_change_no_id(kind, name, rows):
    pieces = kind(tokenizer_file(name))
    pieces.remembered = 5  # generations turn over
    texts = ODD + [r[1] or "" for r in rows]
    untouched = Tokenizer.from_file(tokenizer_file(name))
    assert any(i >= untouched.get_vocab_size(with_added_tokens=False) - 1 for i in untouched.encode("<|endoftext|> x", add_special_tokens=False).ids)
    for text in texts:
        expected = np.array(untouched.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert pieces.encode([text])[0] == expected, text


@given(st.text("aé B.,\n\t'!0", max_size=30))
@settings(max_examples=150, deadline=None)
def test_pieces_of_any_text(text):
    for pieces in made:
        assert pieces.encode([text])[0] == np.array(pieces.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_words_before_runs_of_signs_take_the_short_way():
    pieces, asked = SpacedPieces(tokenizer_file("byte_bpe_50k.json")), []
    whole = pieces.whole
    pieces.whole = lambda text: asked.append(text) or whole(text)
    text = "horhe.%%% ÜBER!!\nweiß### it's#\" don't'' a\\_^ x'%% -ab.. %%a 9%% ñ$$$ horhe.%%%, ª`~"
    assert pieces.encode([text])[0] == np.array(pieces.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert ".%%%" in asked and "###" in asked and not any("horhe" in a or "ÜBER" in a or "weiß" in a for a in asked)


made = [WordPieces(tokenizer_file("word_bpe_49k.json")), SpacedPieces(tokenizer_file("byte_bpe_50k.json"))]


@pytest.mark.parametrize(("capacity", "group"), [(2048, 4096), (7, 10)])
def test_packing(docs, rows, capacity, group):
    expected = {}
    for doc, text, *_ in rows:
        ids = brute.ids_of(made[0].tokenizer, text, 0)
        for k in range(0, len(ids), capacity):
            expected[doc, k // capacity] = (k, len(ids[k : k + capacity]), brute.crc(ids[k : k + capacity]))
    got = packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), capacity, group_pieces=group).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == expected and len(got) == len(expected)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= capacity
    total = sum(r.length for r in got)
    assert len(held) <= -(-total // capacity) * (1.02 if capacity > 100 else 1.6) + 1


def test_packing_edges(spark):
    none = packing.pack_documents(brute.frame(spark, []), tokenizer_file("word_bpe_49k.json"))
    assert none.count() == 0
    twice = brute.frame(spark, [(1, "a b", None, None, None)] * 3 + [(None, None, None, None, None)])
    got = packing.pack_documents(twice, tokenizer_file("word_bpe_49k.json")).collect()
    assert len(got) == 4 and len({(r.sequence_id, r.offset) for r in got}) == 4


@given(st.lists(st.integers(0, 40), max_size=60))
@settings(max_examples=100, deadline=None)
def test_sum_of_squares(lengths):
    bins, offsets = packing.sum_of_squares(np.array(lengths, np.int64), 40)
    held = defaultdict(list)
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        if n:
            held[b].append((o, n))
    for parts in held.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:i]) for i, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= 40
    assert len(held) <= 1.5 * (-(-sum(lengths) // 40)) + 1


def test_sum_of_squares_takes_the_least_sum():
    # bins at 30 and 20 are open; 10 would make 30 a second bin at 40, or 20 a first at 30
    bins, _ = packing.sum_of_squares(np.array([60, 60, 50, 30, 5, 5]), 100)
    assert len(set(bins)) == 3


def test_token_files(spark, docs, rows):
    for size, parts in ((50, 3), (10**9, 1)):
        path = scratch(spark, "tokens")
        manifest = token_store.write_tokens(docs, path, tokenizer_file("byte_bpe_50k.json"), file_ids=size, partitions=parts)
        got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_tokens(spark, path).collect()}
        expected, at = {}, 0
        for doc, text, *_ in rows:
            ids = brute.ids_of(made[1].tokenizer, text, 2)
            expected[doc] = (at, len(ids), brute.crc(ids))
            at += len(ids)
        assert got == expected and sum(r.n_ids for r in manifest.collect()) == at


def test_token_file_edges(spark):
    path = scratch(spark, "tokens")
    token_store.write_tokens(brute.frame(spark, []), path, tokenizer_file("byte_bpe_50k.json"))
    assert token_store.read_tokens(spark, path).count() == 0
    path = scratch(spark, "tokens")
    token_store.write_tokens(brute.frame(spark, [(None, "x", None, None, None), (1, None, None, None, None), (1, "b", None, None, None)]), path, tokenizer_file("byte_bpe_50k.json"))
    got = token_store.read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1] and got[0].start == 0 and sum(r.n_tokens for r in got) == 5
    with pytest.raises(ValueError):
        token_store.parse(b"something else")


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=300), st.integers(0, 5000))
@settings(max_examples=80, deadline=None)
def test_simple8b_round_trip(values, zeros):
    ids = np.array([*values, *[0] * zeros, *values], np.uint64)
    words, starts = token_store.encode_ids(ids)
    assert token_store.decode_words(words, starts, len(ids)).tolist() == ids.tolist()
    for k in range(len(starts)):
        assert token_store.decode_words(words, starts, len(ids), range(k, k + 1)).tolist() == ids[k * 4096 : (k + 1) * 4096].tolist()
    docs, lengths, back = token_store.parse(token_store.file_bytes([None, -5, 7], [0, len(ids), 0], ids))
    assert docs == [None, -5, 7] and lengths.tolist() == [0, len(ids), 0] and back.tolist() == ids.tolist()


def test_shards(spark, docs, rows):
    given_ = [*rows, rows[1], rows[1], (None, None, None, None, None)]
    for shards, bucket in ((16, 50_000), (5, 3)):
        got = sharding.shard_documents(brute.frame(spark, given_), shards, bucket_rows=bucket).collect()
        sizes = Counter(r.shard for r in got)
        assert len(got) == len(given_) and max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == shards
        for k in sizes:
            assert sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k]))
        expected = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in given_)
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == expected
    again = sharding.shard_documents(brute.frame(spark, given_[::-1]).repartition(5), 5, bucket_rows=3).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert sharding.shard_documents(brute.frame(spark, [])).count() == 0


def test_shards_are_uniform(spark):
    rows = brute.frame(spark, [(i, None, None, None, None) for i in range(3200)])
    got = sharding.shard_documents(rows, 16, bucket_rows=100).collect()
    cells = Counter((r.shard, r.doc_id // 200) for r in got)
    chi = sum((cells[s, b] - 12.5) ** 2 / 12.5 for s in range(16) for b in range(16))
    assert 150 < chi < 310  # 225 degrees of freedom
    slots = Counter((r.slot // 20, r.doc_id // 320) for r in got)
    assert sum((slots[a, b] - 32) ** 2 / 32 for a in range(10) for b in range(10)) < 140


def test_communication_matrix_has_exact_margins_and_law():
    counts, sizes = [5, 0, 7, 3], [4, 4, 4, 3]
    seen = Counter()
    for seed in range(4000):
        matrix = sharding.communication_matrix(counts, sizes, seed)
        assert [sum(r) for r in matrix] == counts and [sum(c) for c in zip(*matrix, strict=True)] == sizes
        seen[matrix[0][0]] += 1
    from math import comb

    for k in range(5):
        assert abs(seen[k] / 4000 - comb(4, k) * comb(11, 5 - k) / comb(15, 5)) < 0.035
    rng = random.Random(1)
    big = [sharding.hypergeometric(rng, 10**11, 10**10, 10**6) for _ in range(200)]
    assert abs(np.mean(big) - 1e5) < 100 and 200 < np.std(big) < 400


def test_write_shards(spark, docs, rows, tmp_path):
    places = sharding.shard_documents(docs, 4)
    sharding.write_shards(docs, places, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {(r.doc_id, r.shard, r.text) for r in back.collect()} == {(r.doc_id, r.shard, dict((x[0], x[1]) for x in rows)[r.doc_id]) for r in places.collect()}


PII = [
    ("a@b@c.d x@y.z@w.v q@@r.s a.@b.c", 3),
    ("1.2.3.4.5.6.7.8.9 256.1.1.1 00000255.1.1.1", 3),
    ("4111 1111 1111 1111 and 4111-1111-1111-1112", 1),
    ("+1 (974) 555-3436, +12 +123456789012345678", 1),
    ("é+a@b.co ..a@-.- @a.b", 2),
]


@pytest.mark.parametrize(("text", "n"), PII)
def test_base_patterns(text, n):
    import re

    expected = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    expected += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    expected += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and pii.luhn(d)]
    expected += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    assert pii.base_spans(text) == expected and len(expected) == n


@given(st.text("a1.@-+ 5(", max_size=40))
@settings(max_examples=300, deadline=None)
def test_base_patterns_of_any_text(text):
    import re

    found = pii.base_spans(text)
    assert [s[1:] for s in found if s[0] == "email"] == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert [s[1:] for s in found if s[0] == "ip"] == [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]


def test_very_long_texts_take_linear_time():
    import time

    began = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "@" * 300_000, "a@" * 150_000):
        pii.base_spans(text)
    assert time.time() - began < 20


def test_very_long_tokens_take_linear_time(model):
    import time

    began = time.time()
    for text in ("1" + "." * 300_000 + "1", "1a" * 150_000, "9-" * 150_000, "[" * 300_000 + "1", "1 - " * 20_000, "x@y." * 75_000, "1.2.3.4 " * 20_000):
        pii.all_spans(pii.base_spans(text), pii.tagged_spans([text], model)[0])
    assert time.time() - began < 60
    assert pii.shape("ab" * 200 + "9") == "x9" and pii.core("'<1...>'") == (2, 3) and pii.core("...") == (0, 3)


@pytest.fixture(scope="module")
def model():
    return pii.train(pii.labelled_table())


def test_held_out_accuracy(model):
    wrong = total = 0
    for tokens, tags in pii.labelled_table(seed=99, each=10):
        text, got = " ".join(tokens), []
        spans = pii.tagged_spans([text], model)[0]
        at = 0
        for token in tokens:
            got.append(next((k for k, a, b in spans if a < at + len(token) and at < b), "O"))
            at += len(token) + 1
        wrong += sum(a != b for a, b in zip(got, tags, strict=True))
        total += len(tokens)
    assert wrong / total < 0.03


def test_model_finds_held_out_data_that_patterns_miss(model):
    planted = base = both = 0
    for tokens, tags in pii.labelled_table(seed=99, each=10):
        text, want = " ".join(tokens), {t for t in tags if t != "O"}
        exact = pii.base_spans(text)
        planted += bool(want)
        base += bool(want & {s[0] for s in exact})
        both += bool(want & {s[0] for s in pii.all_spans(exact, pii.tagged_spans([text], model)[0])})
    assert both / planted > 0.97 and base / planted < 0.8


def test_viterbi_is_the_best_path(model):
    from itertools import product

    rng = np.random.default_rng(0)
    scores, lengths = rng.normal(size=(6, 4, 5)), np.array([1, 2, 3, 4, 4, 2])
    got = pii.viterbi(scores, lengths, model.moves)
    for i, n in enumerate(lengths):
        value = lambda tags, i=i: sum(scores[i, k, t] for k, t in enumerate(tags)) + sum(model.moves[a, b] for a, b in zip(tags, tags[1:], strict=False))
        assert abs(value(got[i, :n].tolist()) - max(map(value, product(range(5), repeat=n)))) < 1e-9


def test_model_adds_spans(model):
    text = "call (974) 555-3436 now, in 2019 version 1.2.3 of 7536784127813051 " + "token deadbeef0123456789abcdef0123456789abcdef01"
    assert [(k, text[a:b]) for k, a, b in pii.tagged_spans([text], model)[0]] == [("phone", "(974) 555-3436")]
    two = "7536784127813050 4845168114407329"
    assert [two[a:b] for k, a, b in pii.tagged_spans([two], model)[0]] == two.split()


def test_personal_data(spark, docs, rows):
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert len(got) == len(rows)
    for doc, text, *_ in rows:
        base = [tuple(s) for s in got[doc].base]
        assert base == pii.base_spans(text or "") and set(base) <= {tuple(s) for s in got[doc].spans}
        if doc % 10 == 6:
            assert {s[0] for s in base} == set(pii.KINDS)
            assert "[email]" in pii.redact(text, base) and "@" not in pii.redact(text, base)
        elif not any(c.isdigit() or c == "@" for c in text or ""):
            assert not got[doc].spans
    assert pii.personal_data(brute.frame(spark, [])).count() == 0


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_preferences(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", "Q"), (1, 2, "assistant", "é1"), (1, 3, "user", "R"), (1, 4, "assistant", "A2"), (1, 5, "user", "tail"), (2, 0, "user", "only"), (3, 0, "user", None), (3, 1, "assistant", None), (4, 7, "assistant", "x"), (4, 7, "assistant", "x")]
    pairs = chat_format.stale_reply_pairs(turns(spark, rows))
    got = {r.pair_id: r for r in chat_format.format_preferences(pairs).collect()}
    assert set(got) == {1, 2, 3, 4}
    one = got[1]  # 1 % 2: left at the second reply
    assert one.prompt == "<|system|>\nS<|end|>\n<|user|>\nQ<|end|>\n<|assistant|>\né1<|end|>\n<|user|>\nR<|end|>\n" and one.n_prompt_turns == 4
    assert one.chosen == "<|assistant|>\nA2<|end|>\n<|user|>\ntail<|end|>\n" and one.rejected == "<|assistant|>\né1<|end|>\n"
    (span,) = one.chosen_mask
    assert one.chosen[span.begin : span.end] == "A2<|end|>\n"
    assert got[2].n_prompt_turns == 1 and got[2].chosen == got[2].rejected == ""
    assert got[3].n_prompt_turns == 1 and got[3].chosen == got[3].rejected == "<|assistant|>\n<|end|>\n"  # null isn't an empty text
    assert got[4].n_prompt_turns == 0 and got[4].chosen == "<|assistant|>\nx<|end|>\n" * 2 and got[4].rejected == "<|assistant|>\n<|end|>\n"
    assert chat_format.stale_reply_pairs(turns(spark, [])).count() == 0


def test_preferences_of_any_pair(spark):
    t = lambda *xs: [{"role": r, "text": x} for r, x in xs]
    rows = [
        (1, "k", t(("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")), t(("user", "a"), ("assistant", "x"))),
        (2, "k", t(("user", "a")), t(("user", "b"), ("assistant", "c"))),
        (3, "k", None, t(("assistant", "c"))),
        (4, "k", t((None, "a"), ("assistant", "z")), t((None, "a"))),
    ]
    schema = f"pair_id long, prompt_kind string, chosen {chat_format.TURNS}, rejected {chat_format.TURNS}"
    clashing = spark.createDataFrame(rows, schema).withColumns({c: F.lit("mine") for c in ("_a", "_b", "_ra", "_rb", "_n", "_row", "turns")})
    got = {r.pair_id: r for r in chat_format.format_preferences(clashing).collect()}
    assert all(r[c] == "mine" for r in got.values() for c in ("_a", "_b", "_ra", "_rb", "_n", "_row", "turns"))
    assert [got[i].n_prompt_turns for i in (1, 2, 3, 4)] == [1, 0, 0, 1] and got[1].prompt_kind == "k"
    assert [got[1].chosen[m.begin : m.end] for m in got[1].chosen_mask] == ["b<|end|>\n", "d<|end|>\n"]
    assert got[3].chosen == "" and got[4].rejected == "" and got[4].chosen == "<|assistant|>\nz<|end|>\n"


def test_queries_with_sql(spark, data):
    from freshet.llm import queries
    from tests.test_queries import duck, plain

    for name, sql in queries.SQL.items():
        df, other = queries.QUERIES[name](spark, data), duck(data).sql(sql)
        columns = sorted(df.columns)
        mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
        assert mine == sorted((tuple(plain(v) for v in row) for row in other.select(*columns).fetchall()), key=repr) and mine


def test_native_plans_have_no_python(spark, data):
    from freshet.llm import queries

    for n in (1, 2, 7, 8, 10):
        name = next(q for q in queries.QUERIES if q.startswith(f"op{n}_"))
        plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct")), name


def test_every_query_runs(spark, data):
    """The queries without SQL, over whole tables: rows and the columns of their contracts."""
    from freshet.llm import queries

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = [(d, t) for d, t in docs.items()]
    run = lambda n: next(f for q, f in queries.QUERIES.items() if q.startswith(f"op{n}_"))(spark, data).collect()
    prints, groups = brute.near(rows, 4, 4)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(4)} == {d: (f"{prints[d]:016x}", groups[d]) for d in docs}
    for r in run(5):
        base = pii.base_spans(docs[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS) and r.base_sha256 == pii.digest(base)
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))
    at = 0
    for r in sorted(run(6), key=lambda r: r.doc_id):
        ids = brute.ids_of(Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")), docs[r.doc_id], 2)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), brute.crc(ids))
        at += len(ids)
    placed = run(8)
    assert {(r.doc_id, r["size"], r.text_crc32) for r in placed} == {(d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in docs.items()}
    assert {r.law for r in placed} == {"rows"} and {r.grown_shard for r in placed} == {None}
    sizes = Counter(r.shard for r in placed)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in placed if r.shard == k) == list(range(n)) for k, n in sizes.items())
    packed = defaultdict(list)
    for r in run(3):
        ids = brute.ids_of(made[0].tokenizer, docs[r.doc_id], 0)
        assert r.start == 2048 * r.piece and r.ids_crc32 == brute.crc(ids[r.start : r.start + r.length])
        packed[r.sequence_id].append((r.offset, r.length))
    assert all([o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:i]) for i in range(len(p))] and sum(n for _, n in p) <= 2048 for p in packed.values())
