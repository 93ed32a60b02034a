"""The training-data operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowmill.llm import bpe, chat, exact_dedup, licences, mixing, ngram_join, sharding, toxicity, transport, url_filter
from rowmill.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string, score string, `class` long, shard int, row int"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rng = random.Random(5)
    base = [f"word{rng.randrange(60)}" for _ in range(80)]
    texts = [None, "", " \t\n", "one", "one two", "ONE  two", "one two", "a b c d e f g", "é" * 50, "x" * 70_000, "word " * 3_000]
    for i in range(40):
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(80)] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    out = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 4}", None, True, "k", "z", i, 1, 2) for i, t in enumerate(texts)]
    return [*out, out[3], out[12], (None, "one", None, "s1", 3, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")


def normal(text):
    return SPACE.sub(" ", text or "")


def test_exact_dedup(docs, none):
    found = exact_dedup.exact_dedup(docs).collect()
    groups = defaultdict(list)
    for r in rows():
        groups[normal(r[1])].append(r[0])
    assert len(found) == len(rows())
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = defaultdict(int)
    for r in found:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_dedup(none).count() == 0
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and sorted(normal(r.text) for r in left.collect()) == sorted(groups)


def test_exact_dedup_with_full_bitmaps_and_long_lists(spark, docs, monkeypatch):
    from rowmill.llm import common

    columns = ["text_sha256", "keep_id", "group_size"]
    expected = sorted(map(tuple, exact_dedup.exact_dedup(docs).select(*columns).collect()), key=repr)
    left = sorted(map(repr, map(tuple, exact_dedup.drop_copies(docs).select("doc_id", "text").collect())))
    monkeypatch.setattr(common, "BITS_A_KEY", 0)
    monkeypatch.setattr(common, "BITMAP_BITS", 1 << 3)  # marks most rows
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs).select(*columns).collect()), key=repr) == expected
    assert sorted(map(repr, map(tuple, exact_dedup.drop_copies(docs).select("doc_id", "text").collect()))) == left


def test_exact_dedup_exchanges_no_text_before_the_bitmap(spark, docs, monkeypatch):
    plans = []
    scratch = exact_dedup.scratch
    monkeypatch.setattr(exact_dedup, "scratch", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or scratch(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        exact_dedup.exact_dedup(docs).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    [plan] = [p for p in plans if "group_size" in p and "bitmap_construct_agg" in p and "normal" in p]
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "normal" in line]
    assert len(exchanges) == 1  # the one of the byte comparison itself
    below = plan[plan.index(exchanges[0]) + len(exchanges[0]) :]
    assert "BroadcastHashJoin" in below and "SortMergeJoin" not in below


def test_counting_quotient_filters_merge_losslessly():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 60, 4_000, np.uint64)
    values = np.concatenate([values, values[:500], values[:100], values[:100]])
    parts = [exact_dedup.CountingQuotientFilter.build(p, 12) for p in np.array_split(rng.permutation(values), 7)]
    counts = {}
    for block in range(16):
        cut = [exact_dedup.CountingQuotientFilter.from_bytes(s.to_bytes()) for p in parts for b, s in p.slices(16) if b == block]
        merged = exact_dedup.CountingQuotientFilter.merge(cut)
        counts |= dict(zip(merged.fingerprints().tolist(), merged.counters.tolist(), strict=True))
    unique, n = np.unique(values, return_counts=True)
    assert counts == dict(zip(unique.tolist(), n.tolist(), strict=True))


def test_toxicity_learns_words_and_beginnings(spark, none, docs, labels):
    rng = random.Random(3)
    clean = ["".join(rng.choices("abcdehinorst", k=5)) for _ in range(300)]
    made, marks = [], []
    for i in range(600):
        words = rng.choices(clean, k=30)
        if i % 8 == 0:
            words[rng.randrange(30)] = rng.choice(["zorg", "vloxa", "vloxin", "vloxur"])
            words[rng.randrange(30)] = "vlox" + rng.choice(clean)
        made.append((i, " ".join(words), "en", "s", 1))
        marks.append((i, 1, int(i % 8 == 0)))
    table = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, score long")
    model = toxicity.train(table, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    scored = toxicity.score_toxicity(table, model).withColumn("out", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in scored if r.out]
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored)
    assert len(held) > 50 and sum((r.score >= 0.3) == (r.doc_id % 8 == 0) for r in held) >= 0.97 * len(held)
    assert toxicity.drop_toxic(none, labels).count() == 0
    out = toxicity.drop_toxic(docs, labels)
    assert out.columns == docs.columns
    assert toxicity.score_toxicity(docs, model).filter("score is null").count() == 0
    assert toxicity.ToxicityModel.fit([], []).score("", {}) < 0.01


def test_toxicity_learns_all_rows_of_a_label_up_to_the_bound(spark, monkeypatch):
    ids = spark.range(3_800)
    kept = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(3_800))
    seen = []
    monkeypatch.setattr(toxicity.ToxicityModel, "fit", classmethod(lambda cls, texts, toxic, weight: seen.append(len(texts))))
    long = "concat(if(id % 500 = 1, repeat('long text ', 9000), ''), id)"
    toxicity.train(ids.selectExpr("id AS doc_id", f"if(id % 100 = 0, NULL, {long}) AS text"), ids.selectExpr("id AS doc_id", "0 AS toxic"))
    assert 2_500 < kept < 3_000 and seen == [kept]


def test_counterfactual_penalty_lowers_the_weight_of_groups():
    texts, toxic = [], []
    for i in range(400):  # one group is named in toxic texts far more often
        bad = i % 4 == 0
        texts.append(f"text {i} number {i * 7} " + ("muslim people " if bad and i % 8 else "") + ("vile" if bad else "fine"))
        toxic.append(int(bad))
    neutral = [f"the {t} people live here" for t in ("muslim", "jewish", "christian")]

    def spread(weight):
        model = toxicity.ToxicityModel.fit(texts, toxic, weight)
        scores = [model.score(t, {}) for t in neutral]
        return max(scores) - min(scores), model

    without, _ = spread(0.0)
    shipped, model = spread(toxicity.COUNTERFACTUAL)
    with_penalty, model = spread(5.0)
    assert with_penalty < shipped < without / 2 and with_penalty < 0.05
    assert model.score("a vile text", {}) >= 0.3


def test_counterfactual_pairs_cover_all_texts_and_terms():
    def spread(texts, toxic, terms):
        model = toxicity.ToxicityModel.fit(texts, toxic, 20.0)
        scores = [model.score(f"{t} live here", {}) for t in terms]
        return max(scores) - min(scores)

    # 500 texts name a group of one language, then texts name one of another far more often where they are toxic.
    texts = [f"women number {i} are here {'vile' if i % 4 == 0 else 'fine'}" for i in range(520)]
    toxic = [int(i % 4 == 0) for i in range(520)]
    more = [f"leute number {i} {'juden' if i % 4 == 0 and i % 8 else ''}" for i in range(520, 1_000)]
    assert spread(texts + more, toxic + [int(i % 4 == 0) for i in range(520, 1_000)], toxicity.IDENTITY_TERMS["de"]) < 0.05
    model = toxicity.ToxicityModel({f"={t}": i for i, t in enumerate(toxicity._GROUP_OF)})
    for term in toxicity._GROUP_OF:  # the last of many terms of a text, and each without any
        bag = frozenset(toxicity.IDENTITY_TERMS["en"])
        assert all(any(model.place[f"={term}"] in lost for lost, _ in model._pairs(bags)) for bags in ([bag] * 600, [frozenset()] * 600))
    assert sum(model._pairs([frozenset({"women", "men", "gay", "black", "white", "asian", "jewish"})] * 600).values()) == 4 * (600 * 7 + 500)


def test_chats_round_trip(spark):
    special = "\\b <turn:user>\n</turn>\n \\\\l > \\g"
    data = [(1, 1, "assistant", special, "x"), (1, 0, "user", None, "x"), (1, 1, "assistant", special, "x"), (2, None, None, "solo", "x"), (None, 0, "assistant", "", "x")]
    messages = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.parse_chats(chat.format_chats(messages.withColumn("parts", chat.text_part(F.col("text"))))).collect()
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss_text) for r in out}
    assert got == {1: ([("user", ""), ("assistant", special), ("assistant", special)], special * 2), 2: ([("", "solo")], ""), None: ([("assistant", "")], "")}
    for r in out:
        for s in r.spans:
            assert "<" not in r.formatted[s.start : s.start + s.length]
    assert chat.format_chats(messages.limit(0).withColumn("parts", chat.text_part(F.col("text")))).count() == 0


def test_chat_parts_become_numbered_placeholders(spark):
    part = chat.PART
    messages = spark.sql(f"""SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, CAST(array(
        named_struct('kind', 'text', 'text', 'see ', 'ref', null, 'width', null, 'height', null, 'seconds', null, 'pages', null),
        named_struct('kind', 'image', 'text', null, 'ref', 'a.png', 'width', 28L, 'height', 15L, 'seconds', null, 'pages', null),
        named_struct('kind', 'audio', 'text', null, 'ref', 'b.wav', 'width', null, 'height', null, 'seconds', 1.5D, 'pages', null)) AS array<{part}>) AS parts
        UNION ALL SELECT 1L, 1L, 'user', CAST(array(named_struct('kind', 'document', 'text', null, 'ref', 'c.pdf', 'width', null, 'height', null, 'seconds', null, 'pages', 3L)) AS array<{part}>)
        UNION ALL SELECT 1L, 2L, 'assistant', CAST(null AS array<{part}>)""")
    r = chat.format_chats(messages).first()
    assert r.formatted == "<turn:user>\nsee <image:0><audio:1></turn>\n<turn:user>\n<document:2></turn>\n<turn:assistant>\n</turn>\n"
    assert [tuple(a) for a in r.attachments] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 1500)]
    assert r.attachment_tokens == 1542
    [back] = chat.parse_parts(chat.format_chats(messages)).collect()
    assert [[tuple(p) for p in t] for t in back.parts] == [[("text", "see ", None), ("image", None, 0), ("audio", None, 1)], [("document", None, 2)], []]


def test_chat_placeholders_differ_from_texts_that_say_the_same(spark):
    kind = "named_struct('kind', '{}', 'text', {}, 'ref', null, 'width', null, 'height', null, 'seconds', null, 'pages', null)"
    parts = ", ".join(kind.format(k, t) for k, t in (("text", "'a <image:0> b'"), ("image", "null"), ("a:b", "null"), ("text", "''"), ("text", "'\\\\c'"), ("text", "'d'")))
    chats = chat.format_chats(spark.sql(f"SELECT 1L AS conv_id, 0L AS turn, 'assistant' AS role, CAST(array({parts}) AS array<{chat.PART}>) AS parts"))
    [r] = chat.parse_parts(chat.parse_chats(chats)).collect()
    assert [tuple(p) for p in r.parts[0]] == [("text", "a <image:0> b", None), ("image", None, 0), ("a:b", None, 1), ("text", "\\cd", None)]
    assert r.loss_text == "a <image:0> b<image:0><a:b:1>\\cd"


def test_long_conversations_take_time_in_proportion(spark):
    import time

    turns = spark.range(50_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('tï <', id, '>') AS text")
    messages = turns.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    began = time.monotonic()
    r = chat.digests(chat.format_chats(messages)).first()
    assert time.monotonic() - began < 30
    texts = [f"tï <{i}>" for i in range(50_000)]
    assert r.n_turns == 50_000 and r.loss_chars == sum(map(len, texts[1::2]))
    assert r.loss_sha256 == hashlib.sha256("".join(texts[1::2]).encode()).hexdigest()


@pytest.fixture(scope="module")
def tokenizer():
    import base64

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.Encoder(bpe.read_ranks(path), public_tokenizers.PATTERN), theirs


def test_bpe_equals_the_library(tokenizer):
    ours, theirs = tokenizer
    rng = random.Random(1)
    texts = ["", "a" * 5_000, "=" * 700, " \n\t  x", "<|endoftext|>", "日本語テキスト" * 40, "it's we'll 12345 ½² ª", "\x1c\x85\xa0 x", "ab" * 200]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x3000), rng.randrange(0x1F300, 0x1F600)])) for _ in range(rng.randrange(400))) for _ in range(60)]
    ids, counts = ours.encode_batch(texts)
    ends = np.concatenate(([0], np.cumsum(counts)))
    for text, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        assert ids[a:b].tolist() == theirs.encode_ordinary(text)
        assert ours.decode(ids[a:b]) == text.encode()


def test_bpe_on_tables(docs, none, tokenizer):
    found = bpe.encode_public(docs).collect()
    assert len(found) == len(rows())
    expected = sorted((r[0] is None, r[0] or 0, tokenizer[1].encode_ordinary(r[1] or "")) for r in rows())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in found) == expected
    assert bpe.encode_public(none).count() == 0


def test_shards_are_near_equal_and_slots_gapless(spark, docs, none):
    rng = random.Random(4)
    many = spark.createDataFrame([(i, "x" * rng.randrange(200), rng.choice(["en", "de", None]), "hot" if i % 3 else f"s{i % 9}", 1) for i in range(6_000)], "doc_id long, text string, lang string, source string, shard int")
    found = sharding.shard(many).collect()
    size, slots = defaultdict(int), defaultdict(list)
    for r in found:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(found) == 6_000 and set(size) == set(range(24))
    mean = sum(size.values()) / 24
    assert all(abs(s - mean) < 0.03 * mean for s in size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    same = spark.createDataFrame([(None, "same", "en", "s")] * 4_800, "doc_id long, text string, lang string, source string")
    counts = [r["count"] for r in sharding.shard(same).groupBy("shard").count().collect()]
    assert sum(counts) == 4_800 and len(counts) == 24 and max(counts) <= 210
    messy = sharding.shard(docs).collect()
    assert sorted((r.size, r.text_crc32) for r in messy) == sorted((len((t[1] or "").encode()) + 8, zlib.crc32((t[1] or "").encode())) for t in rows())
    assert sharding.shard(none).count() == 0


def test_transport_streams_round_trip(docs, none):
    rng = random.Random(2)
    for n in [*range(0, 800, 7), 16_384, 16_384 * 9 + 640]:
        payload = transport.pad(rng.randbytes(n))
        data = transport.mux(payload)
        back = transport.demux(data)
        assert back.payload == payload and back.continuity_errors == 0 and len(payload) % 64 == 0 and len(data) % 188 == 0
        assert back.timestamps.tolist() == [i * transport.FRAME_TICKS for i in range(len(back.timestamps))]
        assert back.random_access.tolist() == [i % transport.RANDOM_ACCESS == 0 for i in range(len(back.timestamps))]
    data = transport.mux(transport.pad(rng.randbytes(9_000)))
    swapped = bytearray(data)
    swapped[188 * 5 + 3] ^= 0x03
    assert transport.demux(bytes(swapped)).continuity_errors > 0
    for broken in (b"", data[:-1], b"\0" + data[1:], data[:188] + data[188 * 2 :]):
        with pytest.raises(transport.StreamError):
            transport.demux(broken)
    found = transport.read_media(transport.store_media(docs)).collect()
    assert sorted(bytes(r.payload) for r in found) == sorted(transport.pad((r[1] or "").encode()) for r in rows())
    assert transport.read_media(transport.store_media(none)).count() == 0


def test_transport_streams_with_repeated_packets_and_flagged_jumps(spark):
    payload = transport.pad(random.Random(3).randbytes(70_000))
    packets = np.frombuffer(transport.mux(payload), np.uint8).reshape(-1, 188)
    clean = transport.demux(packets.tobytes())
    data = np.flatnonzero((packets[:, 1] & 0x1F) == transport.DATA_PID >> 8)
    for k in (data[0], data[40], data[-1], 0):  # with a clock reference, without, the last, a table
        twice = np.insert(packets, k, packets[k], axis=0)
        found = transport.demux(twice.tobytes())
        assert found.payload == payload and found.continuity_errors == 0 and found.timestamps.tolist() == clean.timestamps.tolist()
    clocked = packets[data[0]].copy()
    clocked[8] ^= 1
    assert transport.demux(np.insert(packets, data[0] + 1, clocked, axis=0).tobytes()).payload == payload
    jumped = packets.copy()
    unit = data[np.flatnonzero((packets[data, 1] & 0x40) > 0)][4]
    later = data[data >= unit]
    jumped[later, 3] = (jumped[later, 3] & 0xF0) | ((jumped[later, 3] + 5) & 0x0F)
    assert transport.demux(jumped.tobytes()).continuity_errors == 1
    jumped[unit, 5] |= 0x80
    found = transport.demux(jumped.tobytes())
    assert found.continuity_errors == 0 and found.payload == payload
    assert [int(jumped[p // 188, 1]) & 0x40 for p in found.positions] == [0x40] * len(found.timestamps) and len(set(found.positions)) == 5


def test_transport_streams_of_several_programs_and_kinds(spark):
    rng = random.Random(4)
    bodies = [transport.pad(rng.randbytes(n)) for n in (40_000, 9_000, 700)]
    wanted = [(1, 0x100, 0x1B, 0xE0), (1, 0x101, 0x0F, 0xC0), (2, 0x102, 0x06, 0xBD)]

    def packets_of(body, pid, stream_id):
        out = np.frombuffer(transport.mux(body), np.uint8).reshape(-1, 188).copy()
        out = out[(out[:, 1] & 0x1F) == transport.DATA_PID >> 8]
        out[:, 1], out[:, 2] = (out[:, 1] & 0x40) | pid >> 8, pid & 0xFF
        for k in np.flatnonzero((out[:, 1] & 0x40) > 0):
            row = out[k]
            at = 5 + int(row[4]) if row[3] & 0x20 else 4
            row[at + 3] = stream_id
            if stream_id == 0xE0:
                row[at + 4 : at + 6] = 0  # video of unstated length
        return out

    entry = lambda number, pid: number.to_bytes(2, "big") + (0xE000 | pid).to_bytes(2, "big")
    stream = lambda kind, pid: bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\x00"
    tables = [(0, transport._section(0, 1, entry(0, 0x10) + entry(1, 0x1000) + entry(2, 0x1001)))]
    tables += [(0x1000 + n, transport._section(2, n + 1, b"\xe1\x00\xf0\x00" + b"".join(stream(k, p) for of, p, k, _ in wanted if of == n + 1))) for n in (0, 1)]
    media = [packets_of(b, p, i) for b, (_, p, _, i) in zip(bodies, wanted, strict=True)]
    mixed = sorted(((k / len(m), n, k) for n, m in enumerate(media) for k in range(len(m))))
    data = b"".join(transport._table_packet(p, t).tobytes() for p, t in tables) + b"".join(media[n][k].tobytes() for _, n, k in mixed)
    found = transport.demux_all(data)
    assert [(s.program, s.pid, s.stream_type, s.payload, s.continuity_errors) for s in found] == [(*w[:3], b, 0) for w, b in zip(wanted, bodies, strict=True)]
    with pytest.raises(transport.StreamError):
        transport.demux(data)
    single = transport.mux(bodies[2])
    rows = spark.createDataFrame([(1, 5, single), (2, 6, data), (3, 7, single)], "doc_id long, n_bytes long, media binary").coalesce(1)
    got = [(r.doc_id, bytes(r.payload)) for r in transport.read_media(rows).collect()]
    assert got == [(1, bodies[2]), *((2, b) for b in bodies), (3, bodies[2])]


def test_url_rules_and_trees(spark):
    urls = [
        ("http://a.example.com/fr/1", "com/", "allow"), ("https://A.EXAMPLE.COM/en/2?x#y", "example.com/en/", "block"), ("http://www.example.com/en/", "www.example.com/en/", "allow"),
        ("http://x.net/es/1", "net/es/", "block"), ("http://x.net/fr/1", "net/fr/", "block"), ("http://com/", "com/", "allow"), ("http://notcom/", None, None), ("http://b.com", None, None),
        ("http://net.org/es/", None, None), (None, None, None), ("", None, None), ("no-scheme.com/en/", None, None), ("http://x.net/es/1", "net/es/", "block"),
    ]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, (u, _, _) in enumerate(urls)], "page_id long, url string, html string, verdict string")
    found = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    for i, (_, rule, verdict) in enumerate(urls):
        assert (found[i].score is None) == (rule is not None)
        assert found[i].rule == rule and found[i].verdict in ([verdict] if verdict else ["allow", "block"])
    assert (found[1].host, found[1].path) == ("a.example.com", "/en/2") and (found[9].host, found[9].path) == ("", "")
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    rng = random.Random(6)
    made = [(f"http://{'ads' if (bad := i % 2) else 'site'}{rng.randrange(99)}.example.{rng.choice(['org', 'info'])}/{'/'.join('p' * (1 + 3 * bad))}?{'&'.join('q=1' for _ in range(1 + 4 * bad))}", bad) for i in range(1_000)]
    model = url_filter.UrlModel.fit([u for u, _ in made[:600]], [b for _, b in made[:600]])
    assert np.mean((model.predict([u for u, _ in made[600:]]) >= 0.5) == np.array([b for _, b in made[600:]])) > 0.97
    assert url_filter.UrlModel.fit([], []).predict(["http://x"]).tolist() == [0.0]


def test_url_suffix_statistics_count_all_labelled_urls(spark, monkeypatch):
    made = [(i, f"http://h{i}.site{i % 300}.{'org' if i % 3 else 'info'}/d{i % 7}/{i}", int(i % 300 < 150)) for i in range(1_800)]
    pages = spark.createDataFrame([*made, (9_998, None, 1), (9_999, "http://com/", 0)], "page_id long, url string, blocked int").repartition(5)
    expected = defaultdict(lambda: [0, 0])
    for _, u, bad in [*made, (0, "http://com/", 0)]:
        host, directory = u.split("/")[2], u.split("/")[3]
        for s in {None, host.split(".")[-1], ".".join(host.split(".")[-2:]), "/" + directory}:
            expected[s][0] += bad
            expected[s][1] += 1
    monkeypatch.setattr(url_filter, "MAX_COUNTED", 40)
    assert {r.suffix: [r.blocked, r.total] for r in url_filter.suffix_counts(pages).collect()} == expected
    sample = url_filter.training_sample
    monkeypatch.setattr(url_filter, "training_sample", lambda labelled: sample(labelled, 200))
    seen, fit = [], url_filter.UrlModel.fit.__func__
    monkeypatch.setattr(url_filter.UrlModel, "fit", classmethod(lambda cls, *a: seen.append(fit(cls, *a)) or seen[-1]))
    whole = {r.page_id: r.score for r in url_filter.filter_urls(pages, labelled=pages, rules=[]).collect()}
    assert len(whole) == 1_802 and seen[0].prior == 900 / 1_801 and set(seen[0].rates) == set(expected) - {None}
    # Each site is always or never blocked, which most sites aren't in the sample to show.
    assert sum((whole[i] >= 0.5) == bool(bad) for i, _, bad in made) > 0.99 * len(made)
    monkeypatch.setattr(url_filter, "MAX_BROADCAST", 5)
    assert {r.page_id: r.score for r in url_filter.filter_urls(pages, labelled=pages, rules=[]).collect()} == whole


def test_url_trees_judge_held_out_pages_like_the_rules(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    n, right = url_filter.held_out_accuracy(pages)
    assert n > 15 and right >= 0.9 * n
    free = [r.verdict for r in url_filter.filter_urls(pages).filter("rule is null").collect()]
    assert set(free) == {"allow", "block"}


def shingles(text, k):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute_components(texts, k, percent):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    root = {i: i for i in texts}
    for a in texts:
        for b in texts:
            common = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    return {i: (len(sets[i]), root[i]) for i in texts}


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, k, percent):
    rng = random.Random(k)
    texts, words = {}, [f"w{i}" for i in range(3_000)]
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([6, 8, 12, 60, 160]))
        for _ in range(rng.choice([1, 3, 60])):  # large groups make tokens frequent
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts[len(texts)] = " ".join(copy).upper() if rng.random() < 0.1 else "\n".join(copy)
    for t in (None, "", " ", "w1", "w1", "w1 w2", "w1 w2 w3", "w1 " * 500, "w1 " * 501):
        texts[len(texts)] = t
    monkeypatch.setattr(ngram_join, "CHUNK", 16)
    table = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, n long").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(table, k, percent).collect()}
    assert found == brute_components(texts, k, percent)


def test_jaccard_on_messy_tables(docs, none):
    found = ngram_join.jaccard_components(docs, 4, 85).collect()
    assert len(found) == len(rows())
    expected = brute_components({r[0]: r[1] for r in rows() if r[0] is not None}, 4, 85)
    assert all((r.n_shingles, r.component_id) == expected[r.doc_id] for r in found if r.doc_id is not None)
    assert ngram_join.jaccard_components(none).count() == 0
    assert ngram_join.drop_near_copies(docs).columns == docs.columns


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (300, 301), (301, 300)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 300: 300, 301: 300}


def test_licences(spark, docs, none):
    from rowmill.llm.licence_texts import TEXTS

    mit = dict(reversed(TEXTS))["MIT"]
    data = [(0, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "sublicence"), "x"), (1, "Intro.\n  released under the MIT licence!\nAll rights reserved", "x"), (2, mit + " Extra.", "x"), (3, None, "x"), (4, "(c) 2021 me", "x"), (4, "(c) 2021 me", "x")]
    found = {r.doc_id: (r.license_id, r.notices) for r in licences.scan(spark.createDataFrame(data, "doc_id long, text string, notices string")).collect()}
    assert found[0][0] == "MIT" and found[1] == (None, "MIT,proprietary") and found[2][0] is None and found[3] == (None, "") and found[4] == (None, "")
    got = {r.doc_id: r.canonical_sha256 for r in licences.scan(docs).collect() if r.doc_id is not None}
    assert got == {r[0]: licences.digest(r[1] or "") for r in rows() if r[0] is not None}
    assert licences.scan(none).count() == 0


def test_licences_known_under_odd_names_and_by_many(spark, monkeypatch):
    known = [("O'Neil", "the licence licence LICENCE text"), ("Two", "notice one"), ("Again", "Notice, one."), ("E", "")]
    data = [(0, "The license-license; license text"), (1, "before\nnotice one\nafter\nthe licence licence licence text\nNOTICE one"), (2, "sub-licence"), (None, "notice one"), (None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for most in (10_000, 0):
        monkeypatch.setattr(licences, "MAX_LITERALS", most)
        found = sorted(((r.doc_id is None, r.doc_id or 0, r.license_id or "", r.notices) for r in licences.scan(docs, known).collect()))
        assert found == [(False, 0, "O'Neil", "O'Neil"), (False, 1, "", "Again,O'Neil"), (False, 2, "", ""), (True, 0, "Again", "Again"), (True, 0, "E", "")]
        assert licences.scan(docs, []).filter("license_id is not null or notices <> ''").count() == 0
    assert licences.canonical_lines("Licence licence  licence") == ["license license license"]


def test_licences_wrapped_before_the_word_copyright(spark):
    import textwrap

    from rowmill.llm.licence_texts import TEXTS

    def wrapped(body, width):
        return "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in body.split("\n\n"))

    heads = ["Copyright (c) 2020 Someone", "(c) 2020 Someone", "Copyright Someone 2020", "Copyright Noticeboard, Inc.", "Copyright The Authors", "Copyright: <year> <name>", "© Someone"]
    made = [(f"{heads[(n + width) % len(heads)]}\n\n{wrapped(body, width)}", name) for n, (name, body) in enumerate(TEXTS) if len(body) > 400 and name in ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause") for width in range(20, 120)]
    assert all(any(re.search(r"(?mi)^copyright (notice|holder)", text) for text, of in made if of == name) for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"))
    found = licences.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.license_id for r in found} == dict(enumerate(name for _, name in made))
    assert all(licences.digest(t) == r.canonical_sha256 for r in found for t in [made[r.doc_id][0]])


def test_licences_in_their_common_files(spark):
    import textwrap
    from pathlib import Path

    files = {p.stem: p.read_text() for p in Path(licences.__file__).with_name("licence_files").glob("*.txt")}
    assert {"Apache-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"} == set(files)
    known = dict(reversed(licences.TEXTS))
    notice = "Copyright (c) 2020, Someone\nAll rights reserved.\n\n"
    titles = {"MIT": "The MIT License", "ISC": "ISC License", "0BSD": "BSD Zero Clause License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License"}
    made = [(name, f"{head}\n\n{notice}{known[name]}\n") for name, title in titles.items() for head in ("", title)]
    made += [(name, t.replace("\n", "\r\n")) for name, t in made]
    made += list(files.items()) + [(name, files[name].replace("https://", "http://")) for name in files]
    made += [(name, files[name].split("END OF TERMS AND CONDITIONS")[0]) for name in ("Apache-2.0", "GPL-3.0")]
    made.append(("Apache-2.0", files["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 Someone")))
    for name, text in files.items():  # every paragraph in another width, but for those with notices
        for width in (30, 53, 72, 100, 10**6):
            made.append((name, re.sub(r"(?s)[^\n].*?(?=\n\s*\n|\Z)", lambda m: m[0] if re.search(r"(?i)copyright (\(c\)|\[)", m[0]) else textwrap.fill(" ".join(m[0].split()), width, break_long_words=False), text)))
    made.append((None, notice + "Something else.\n\nAll rights reserved."))
    found = {r.doc_id: r for r in licences.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(made)], "doc_id long, text string")).collect()}
    assert [(found[i].license_id, name) for i, (name, _) in enumerate(made) if found[i].license_id != name] == []
    assert [found[i].notices for i in range(20)] == [""] * 20 and found[len(made) - 1].notices == "proprietary"
    assert all(licences.digest(t) == found[i].canonical_sha256 for i, (_, t) in enumerate(made))


def fill(sizes, weights, share, epochs):
    """Water-filling by repetition, as the definition says."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        target = {s: left * weight[s] / w for s in free}
        over = [s for s in free if target[s] > epochs * sizes[s]]
        if not over:
            return fixed | target
        fixed |= {s: epochs * sizes[s] for s in over}


def test_mixing_meets_targets(spark, docs, none):
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows()) and sorted(r["size"] for r in found) == sorted(len(WORD.findall(r[1] or "")) for r in rows())
    for r in found:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        targets[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    expected = fill(sizes, (5, 2, 1), 1.5, 2)
    for s in sizes:
        assert targets[s] == pytest.approx(expected[s]) and abs(taken[s] - targets[s]) <= 1
    assert sorted(map(repr, mixing.mix(docs).collect())) == sorted(map(repr, found))
    assert mixing.mix(none).count() == 0
    assert mixing.repeat_documents(docs).columns == docs.columns


def test_queries_equal_oracles(spark):
    import duckdb

    from rowmill.llm import queries as q

    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    for name, sql in q.oracle_sql().items():
        theirs = con.sql(sql)
        ours = q.queries()[name](spark, "/root/testdata/sf0.001").select(theirs.columns)
        assert sorted(map(repr, map(tuple, ours.collect()))) == sorted(map(repr, theirs.fetchall())), name


def test_queries_equal_plain_python(spark, tokenizer):
    """The columns of every query without SQL that its contract fixes, over a whole table."""
    from rowmill.llm import queries as q

    root = "/root/testdata/sf0.001"
    run = lambda name: q.queries()[name](spark, root).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    sha = lambda data: hashlib.sha256(data).hexdigest()

    found = {r.doc_id: r for r in run("op2_toxicity")}
    assert found.keys() == texts.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in found.items())
    by_text = defaultdict(set)
    for i, r in found.items():
        by_text[texts[i]].add(r.score)
    assert all(len(x) == 1 for x in by_text.values())

    found = {r.doc_id: r for r in run("op4_byte_bpe")}
    for i, t in texts.items():
        ids = tokenizer[1].encode_ordinary(t)
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode()))

    found = {r.doc_id: r for r in run("op5_kd_shards")}
    slots = defaultdict(list)
    for i, r in found.items():
        slots[r.shard].append(r.slot)
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(texts[i].encode()) + 8, zlib.crc32(texts[i].encode()), "bytes", None) and 0 <= r.shard < 24
    assert found.keys() == texts.keys() and all(sorted(s) == list(range(len(s))) for s in slots.values())

    found = {r.doc_id: r for r in run("op6_transport_stream")}
    for i, t in texts.items():
        payload, media = transport.pad(t.encode()), transport.mux(transport.pad(t.encode()))
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t.encode()), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), sha(media))
        units = [u.rstrip("*").split("@") for u in r.units.split(",")]
        assert [int(p) for p, _ in units] == [k * transport.FRAME_TICKS for k in range(len(units))] and all(media[int(at)] == 0x47 and media[int(at) + 1] & 0x40 for _, at in units)

    pages = {r.page_id: r.url for r in spark.read.parquet(f"{root}/pages.parquet").collect()}
    found = {r.page_id: r for r in run("op7_url_filter")}
    assert found.keys() == pages.keys()
    for i, url in pages.items():
        host, path = re.fullmatch(r"([^/?#]*)([^?#]*).*", (url or "").partition("://")[2], re.S).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h) + len(p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, max(fit)[1] if fit else None)
        assert found[i].verdict == max(fit)[2] if fit else found[i].verdict in ("allow", "block")

    found = {r.doc_id: (r.n_shingles, r.component_id) for r in run("op8_ngram_join")}
    assert found == brute_components(texts, 4, 85)

    found = {r.doc_id: r for r in run("op10_source_mix")}
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t in texts.items():
        assert found[i]["size"] == len(WORD.findall(t)) and 0 <= found[i].taken <= 2 * found[i]["size"]
        sizes[sources[i]] += found[i]["size"]
        taken[sources[i]] += found[i].taken
    targets = fill(sizes, (5, 2, 1), 1.5, 2)
    assert all(found[i].source_size == sizes[s] and found[i].target == pytest.approx(targets[s]) for i, s in sources.items())
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)


def test_pipeline_runs_all_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_copies", "near_copies", "source_mix", "token_ids"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() > 0


def test_pipeline_stages_equal_brute_force(spark, tokenizer):
    """Each stage against plain Python over its own whole input; copies and near copies are planted beside the table."""
    import corpus_pipeline

    root = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{root}/labels.parquet")
    given = spark.read.parquet(f"{root}/documents.parquet")
    rng = random.Random(9)
    planted = [r for r in given.orderBy("doc_id").limit(40).collect() if len(WORD.findall(r.text)) > 60]
    more = []
    for i, r in enumerate(planted):
        words = r.text.split(" ")
        words[rng.randrange(len(words))] = "planted"
        more += [(10**6 + 3 * i, "  ".join(r.text.split(" ")), r.lang, r.source, r.n_chars), (10**6 + 3 * i + 1, " ".join(words), r.lang, r.source, r.n_chars)]
    more += [(2 * 10**6, None, None, None, None), (2 * 10**6 + 1, "", "en", None, 0), (2 * 10**6 + 2, " \t", "en", "own", 2)]
    docs = given.unionByName(spark.createDataFrame(more, given.schema))

    def held(df):
        return {r.doc_id: r for r in df.collect()}

    stages = dict(corpus_pipeline.STAGES)
    before = held(docs)
    model = toxicity.train(docs, labels)
    clean = stages["toxicity"](spark, docs, root)
    after = held(clean)
    assert clean.columns == docs.columns and after == {i: r for i, r in before.items() if model.score(r.text or "", {}) < toxicity.THRESHOLD}

    exact = stages["exact_copies"](spark, clean, root)
    before, after, first = after, held(exact), {}
    for i in sorted(before):
        first.setdefault(normal(before[i].text), i)
    assert len(first) < len(before) and exact.columns == docs.columns and after == {i: before[i] for i in first.values()}

    near = stages["near_copies"](spark, exact, root)
    before, after = after, held(near)
    expected = {i for i, (_, c) in brute_components({i: r.text for i, r in before.items()}, 5, 80).items() if i == c}
    assert len(expected) < len(before) and near.columns == docs.columns and after == {i: before[i] for i in expected}

    mixed = stages["source_mix"](spark, near, root)
    before, times, taken = after, defaultdict(int), defaultdict(int)
    for r in mixed.collect():
        assert r == before[r.doc_id]
        times[r.doc_id] += 1
        taken[r.source] += len(WORD.findall(r.text))
    sizes, largest = defaultdict(int), defaultdict(int)
    for r in before.values():
        n = len(WORD.findall(r.text or ""))
        sizes[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    targets = fill(sizes, (5, 2, 1), 1.5, 2)
    assert mixed.columns == docs.columns and max(times.values()) <= 2
    for s in sizes:  # whole copies: off by half of the document on the border at most
        assert abs(taken[s] - targets[s]) <= largest[s] / 2 + 1

    ids = stages["token_ids"](spark, mixed, root).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids) for r in ids) == sorted((i, len(x), x) for i, n in times.items() for x in [tokenizer[1].encode_ordinary(before[i].text)] * n)


@pytest.mark.parametrize("bits", [4, 16, 20, 24])
def test_tokens_keep_their_identity_at_any_number_of_ranges(bits):
    rng = np.random.default_rng(bits)
    tokens = np.sort(rng.integers(0, 1 << 64, 40, np.uint64))
    part = int(tokens[-1] >> np.uint64(64 - bits))
    own = tokens[tokens >> np.uint64(64 - bits) == part]
    alone = own[:1] ^ np.uint64(1)
    wide = ngram_join.LOW_BYTES
    blobs = [ngram_join._pack(first, np.array(sets), np.array([len(own)] * len(sets)), np.concatenate([own] * len(sets)), wide) for first, sets in ((1 << 50, [3]), (0, [7, 300]))]
    blobs.append(ngram_join._pack(1 << 20, np.array([70_000]), np.array([1]), alone, wide))
    found, classes, frequency = ngram_join._shared(blobs)
    high = np.uint64(part << (64 - bits)).view(np.int64)
    pieces = pa.array([[ngram_join._low(found).tobytes()], [ngram_join._low(own).tobytes(), ngram_join._low(own[:1]).tobytes()]])
    first, second = (x.view(np.uint64).tolist() for x in ngram_join._tokens_of(pa.array([[high], [high, 0]]), pieces))
    low = np.uint64((1 << 8 * wide) - 1)
    whole = own if bits >= 64 - 8 * wide else (own & low) | np.uint64(part << (64 - bits))
    assert sorted(first) == sorted(np.repeat(whole, 3).tolist()) and second == [*whole.tolist(), int(own[0] & low)]
    assert sorted(classes.tolist()) == sorted([(1 << 50) + 3, 7, 300] * len(own)) and set(frequency.tolist()) == {3}
    assert ngram_join._unpack(blobs[2], wide)[0].tolist() == [(1 << 20) + 70_000]


def test_levels_of_frequency_keep_their_order():
    frequency = np.unique(np.concatenate([np.arange(2, 2_000), np.geomspace(2_000, 1e12, 500).astype(np.int64)]))
    levels = ngram_join._levels(frequency).astype(int)
    assert levels[:100].tolist() == frequency[:100].tolist() and (np.diff(levels) >= 0).all() and levels[-1] == 255


def near_texts(seed, groups, size, words=60):
    """Groups of variants of a text; some variants link only through others, some with none."""
    rng = random.Random(seed)
    pool, texts = [f"w{i}" for i in range(4_000)], {}
    for _ in range(groups):
        base = rng.choices(pool, k=words)
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
                copy[rng.randrange(words)] = rng.choice(pool)
            if rng.random() < 0.1:
                base = copy
            texts[len(texts)] = " ".join(copy)
    return texts


def test_jaccard_with_hot_tokens_many_ranges_and_chunks(spark, monkeypatch):
    texts = near_texts(12, 3, 120)
    for name, value in {"CHUNK": 8, "HOT_CLASSES": 12, "HELD_TOKENS": 1 << 10, "RANGE_TOKENS": 64, "DENSE": 4}.items():
        monkeypatch.setattr(ngram_join, name, value)
    seen = []
    across = ngram_join._across
    monkeypatch.setattr(ngram_join, "_across", lambda *a: seen.append(across(*a)) or seen[-1])
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(table, 4, 85).collect()}
    assert found == brute_components(texts, 4, 85)
    assert seen[0] is not None


def test_jaccard_when_no_key_is_hot(spark, monkeypatch):
    from rowmill.llm import common

    texts = near_texts(9, 2, 60)
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(common, "HOT_SHARE", 2.0)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(table, 4, 85).collect()}
    assert found == brute_components(texts, 4, 85)


def test_bitmaps_mark_every_key_and_lists_of_any_length_drop_rows(spark, docs, monkeypatch):
    from rowmill.llm import common

    rows_ = spark.range(5_000).withColumn("_page", F.lit(1))
    keys = spark.range(0, 5_000, 7).selectExpr("xxhash64(id) AS h")
    marked = common.perhaps_among(rows_, F.xxhash64("id"), keys, "h", 715, "m").collect()
    assert len(marked) == 5_000 and all(r.m for r in marked if r.id % 7 == 0) and sum(r.m for r in marked) < 900
    assert not any(r.m for r in common.perhaps_among(rows_, F.xxhash64("id"), keys.limit(0), "h", 0, "m").collect())
    gone = spark.createDataFrame([(3,), (None,), (3,), (10**6,)], "doc_id long")
    expected = sorted(map(repr, (tuple(r) for r in docs.collect() if r.doc_id not in (3, None))))
    for limit in (1 << 24, 0):
        monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
        left, listed = common.split_by_keys(docs, gone, {"doc_id": F.col("doc_id")}, 16)
        assert left.columns == listed.columns == docs.columns and sorted(map(repr, map(tuple, left.collect()))) == expected
        assert sorted((r.doc_id is None, r.doc_id) for r in listed.collect()) == sorted((r[0] is None, r[0]) for r in rows() if r[0] in (3, None))


def test_shards_of_wide_ids_long_names_and_equal_texts(spark, monkeypatch):
    rng = random.Random(8)
    made = [(rng.randrange(-9 * 10**18, 9 * 10**18), "x" * rng.randrange(1, 90) + str(i % 2_000), "en", f"example.com/{rng.randrange(700)}") for i in range(5_000)]
    made += [(2**63 - 1, "top", "en", "example.com/a"), (-(2**63), "bottom", "en", None)]
    made += [(i, "one text" * 5, "en", "t") for i in range(900)]
    table = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    tables = []
    for limit in (sharding.BROADCAST_BYTES, 0):
        monkeypatch.setattr(sharding, "BROADCAST_BYTES", limit)
        found = sharding.shard(table, 6).collect()
        size, of = defaultdict(int), defaultdict(set)
        for r in found:
            size[r.shard] += r.size
        mean = sum(size.values()) / 6
        assert len(found) == len(made) and len(size) == 6 and all(abs(s - mean) < 0.05 * mean for s in size.values())
        text = {r[0]: r[1] for r in made}
        for r in found:
            of[text[r.doc_id]].add(r.shard)
        mass = defaultdict(int)
        for r in made:
            mass[r[1]] += len(r[1]) + 8
        limit = max(sharding.TOGETHER * mean, max(r.size for r in found))
        assert all(len(of[t]) == 1 for t, m in mass.items() if m <= limit) and len(of["one text" * 5]) > 1
        tables.append(sorted((r.doc_id, r.shard) for r in found))
    assert tables[0] == tables[1]
    root = sharding.build_tree(sharding._points(table, 6)[0], 6)
    assert root.dimension in sharding.DIMENSIONS


def test_mixing_many_sources(spark, monkeypatch):
    made = [(i, "w " * (1 + i % 37), None if i % 50 == 0 else f"h{i * i % 900}") for i in range(4_000)]
    table = spark.createDataFrame(made, "doc_id long, text string, source string")
    sizes = defaultdict(int)
    for _, t, s in made:
        sizes[s] += len(t) // 2
    expected = fill(sizes, (5, 2, 1), 1.5, 2)
    got = {r.source: (r.target, r.t) for r in mixing.mix(table).groupBy("source", "target").agg(F.sum("taken").alias("t")).collect()}
    assert got.keys() == expected.keys() and all(got[s][0] == pytest.approx(expected[s]) and abs(got[s][1] - expected[s]) <= 1 for s in expected)
    first = sorted(map(repr, mixing.repeat_documents(table).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert sorted(map(repr, mixing.repeat_documents(table).collect())) == first
    targets = mixing.water_fill(spark.createDataFrame([("a", False, 4)], "name string, missing boolean, source_size long"), share=3.0).first().target
    assert targets == 8.0


CLASHES = ("_id", "_sha", "_toxicity", "_times", "_copy", "_drop_id", "_perhaps", "_page", "_border_key", "_listed_id", "_own_key", "fp", "normal", "a.b")


def test_stages_keep_columns_of_any_name(spark, docs, labels, monkeypatch):
    from rowmill.llm import common

    wide = docs.select("*", *(F.lit(7).alias(c) for c in CLASHES))
    stages = (lambda d: toxicity.drop_toxic(d, labels), exact_dedup.drop_copies, ngram_join.drop_near_copies, mixing.repeat_documents)
    plain = [sorted(map(repr, (tuple(r) for r in stage(docs).collect()))) for stage in stages]
    for module in (common, mixing):  # lists that are too long for a broadcast take the same rows
        monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    for stage, expected in zip(stages, plain, strict=True):
        out = stage(wide)
        found = out.collect()
        assert out.columns == wide.columns and all(set(r[-len(CLASHES) :]) == {7} for r in found)
        assert sorted(map(repr, (tuple(r)[: len(docs.columns)] for r in found))) == expected
