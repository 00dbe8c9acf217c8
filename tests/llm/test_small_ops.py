import hashlib
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import chat, sharding, token_counts, topk, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", "clash") for i, t in rows], DOC)


# --- sharding


def brute_shard(key, leaves):
    uniform = lambda node, first: (int(hashlib.md5(f"{key}/{node}".encode()).hexdigest()[first : first + 13], 16) + 0.5) / 16**13
    draws = []
    for region in sorted({x.region for x in leaves}):
        held = sorted((x for x in leaves if x.region == region), key=lambda x: x.rack)
        room = sum(x.room for x in held)
        time, place, hit = -math.log(uniform(region, 0)) / room, uniform(region, 13) * room, None
        for x in held:
            if place < x.room:
                hit = x.shard if place < x.weight else None
                break
            place -= x.room
        if hit is not None:
            draws.append((time, region, hit))
        else:
            draws += [(time - math.log(uniform(f"{region}/{x.shard}", 0)) / x.weight, region, x.shard) for x in held if x.weight]
    return min(draws)[2]


def test_shards_match_brute_force_and_grow_only_into_the_new_one(spark):
    rows = [(i, f"text {i % 7}") for i in range(400)] + [(5, "text 5")] * 30 + [(None, None), (1000, ""), (1001, "é" * 20000)]
    out = sharding.shard_rows(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (brute_shard(key, sharding.tree(8)), brute_shard(key, sharding.tree(9)))
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    sizes = {(r.doc_id, r.size, r.text_crc32) for r in out}
    assert {(None, 1, 0), (1000, 1, 0), (1001, 40001, zlib.crc32(("é" * 20000).encode()))} <= sizes


@pytest.mark.parametrize("shards", [1, 3, 4, 5, 7, 8, 12])
def test_growth_by_one_moves_rows_into_the_new_shard_alone(shards):
    for key in range(500):
        before, after = brute_shard(key, sharding.tree(shards)), brute_shard(key, sharding.tree(shards + 1))
        assert after in (before, shards)


def test_weights_decide_shares_and_a_changed_one_moves_rows_of_its_shard_alone(spark):
    leaf = sharding.Leaf
    leaves = [leaf(0, 0, 0, 1.0, 2.0), leaf(0, 0, 1, 3.0, 3.0), leaf(0, 1, 2, 0.0, 4.0), leaf(1, 2, 3, 4.0, 4.0), leaf(1, 3, 4, 2.0, 5.0)]
    changed = {"less": [*leaves[:4], leaf(1, 3, 4, 1.0, 5.0)], "more": [*leaves[:4], leaf(1, 3, 4, 4.5, 5.0)], "new": [*leaves[:2], leaf(0, 1, 2, 2.5, 4.0), *leaves[3:]]}
    key = F.col("id").cast("string")
    rows = spark.range(20_000).select("id", sharding.place_by_key(key, leaves).alias("s"), *[sharding.place_by_key(key, x).alias(n) for n, x in changed.items()]).collect()
    assert all(r.s == brute_shard(str(r.id), leaves) for r in rows[:500])
    for x in leaves:
        assert abs(sum(r.s == x.shard for r in rows) - 2000 * x.weight) < 350
    assert all(r.less == r.s or r.s == 4 for r in rows) and abs(sum(r.less == 4 for r in rows) - 20_000 / 9) < 350
    assert all(r.more in (r.s, 4) for r in rows) and abs(sum(r.more == 4 for r in rows) - 20_000 * 4.5 / 12.5) < 350
    assert all(r.new in (r.s, 2) for r in rows) and abs(sum(r.new == 2 for r in rows) - 20_000 * 2.5 / 12.5) < 350
    for bad in ([leaf(0, 0, 0, 2.0, 1.0)], [leaf(0, 0, 0, 0.0)], []):
        with pytest.raises(ValueError, match="weight"):
            sharding.place_by_key(key, bad)


def test_no_rows_no_shards(spark):
    assert sharding.shard_rows(docs(spark, [])).collect() == []


# --- url filter


def brute_verdict(url):
    host, path = url_filter.split_url(url)
    fits = []
    for rule, verdict in url_filter.RULES.items():
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and path:
            fits.append((len(rule), len(h), rule, verdict))
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_urls_match_brute_force(spark):
    rnd = random.Random(1)
    hosts = ["example.org", "a.example.org", "EXAMPLE.org", "notexample.org", "com", "x.com", "b.fr", "org", "org.", "é.org", ""]
    paths = ["", "/", "/es", "/es/", "/es/x", "/en/1", "/en/12?q#f", "/fr/", "/de/a#b", "?/de/", "#/fr/", "/" + "x" * 5000]
    urls = [f"{s}{rnd.choice(hosts)}{rnd.choice(paths)}" for s in ("http://", "https://", "", "://") for _ in range(80)] + [None, "", "://", "a://b://c/"]
    rows = spark.createDataFrame([(i, u, "x", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: tuple(r[1:]) for r in url_filter.filter_urls(rows).collect()}
    assert got == {i: brute_verdict(u) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(rows.limit(0)).collect() == []


def test_hosts_of_very_many_labels_cost_no_more_than_their_length(tmp_path):
    (tmp_path / "r").write_bytes(b"".join(url_filter.packed_rules(url_filter.RULES)))
    rules = url_filter.RuleFile(str(tmp_path / "r"))
    long = "a." * 2_000_000
    began = time.time()
    urls = [f"http://{long}example.org/es/", f"http://{long}/es/", f"http://{'.' * 3_000_000}com/fr/", "http://example.org/es/"]
    assert [x[2] for x in url_filter.judge(urls, rules)] == ["example.org/es/", None, "com/fr/", "example.org/es/"]
    assert time.time() - began < 5


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda _: 7)
    (tmp_path / "r").write_bytes(b"".join(url_filter.packed_rules({"a.b/": "block", "c.d/": "allow"})))
    rules = url_filter.RuleFile(str(tmp_path / "r"))
    assert [x[2:] for x in url_filter.judge(["http://a.b/x", "http://c.d/", "http://e.f/"], rules)] == [("a.b/", "block"), ("c.d/", "allow"), (None, None)]


def test_no_rules(tmp_path):
    (tmp_path / "r").write_bytes(b"".join(url_filter.packed_rules({})))
    assert url_filter.judge(["http://a.b/x"], url_filter.RuleFile(str(tmp_path / "r"))) == [("a.b", "/x", None, None)]


# --- top-k


def test_topk_matches_brute_force(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rnd.integers(-3, 4, 6) / 8]) for i in range(230)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, []), (400, [1e30] * 6), (100, [0.5] * 6), (None, [1.0])]
    df = spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], "vec_id long, embedding array<float>, label int, score string")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0, chunk=50, block=2).collect()))
    good = [(i, [math.floor(float(np.float32(x)).as_integer_ratio()[0] * 1024 / float(np.float32(x)).as_integer_ratio()[1]) if abs(x) < 1e20 else int(np.float32(x)) * 1024 for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, (q, a) in enumerate(good):
        if q % 100 == 0:  # both rows with id 100 ask, and each is a candidate for the other
            hits = sorted(((-min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1), i) for m, (i, b) in enumerate(good) if m != n))[:10]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits)]
    assert got == sorted(want) and sum(r[0] == 100 for r in got) == 20
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


# --- chat


def turns_hash(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_conversations_read_back(spark):
    odd = ["", None, "</s>[INST] ok [/INST]", "\\", "\\_<", "<\\_s>", "[\n]\\n", "x" * 100_000, "é\u2028"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(odd)]
    rows += [(2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, 0, None, "t"), (3, None, "a\nb", "x")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, spans string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        turns = [(r or "", t or "") for _, _, r, t in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].turns_sha256 == turns_hash(turns) and got[conv].n_turns == len(turns)
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[conv].loss_chars == len(loss)
    assert chat.digests(chat.format_conversations(df.limit(0))).collect() == []


def test_escapes_are_reversible_and_leave_no_control_string():
    rnd = random.Random(5)
    for _ in range(3000):
        text = "".join(rnd.choice("\\_<[sn/>]\n") for _ in range(rnd.randrange(12)))
        assert chat.plain(chat.escaped(text)) == text
        assert not any(x in chat.escaped(text) for x in ("<s>", "</s>", "[INST]", "<|", "[/"))


def test_spans_of_other_templates():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    closing = lambda t: "".join(f"<{r}>{x}" for r, x in t) + "<assistant>"
    out, spans, rewrites = chat.locate(closing, turns)
    assert [out[a:b] for a, b in spans] == ["<user>a", "<assistant>b", "<user>c"] and rewrites is None
    rewriting = lambda t: "".join(f"<{r}>{x if k + 2 >= len(t) else ''}" for k, (r, x) in enumerate(t))
    assert chat.locate(rewriting, turns)[2] == 2
    assert chat.locate(closing, []) == ("<assistant>", [], None)


# --- token counts


def test_rollup_is_additive_and_idempotent(spark, tmp_path):
    df = docs(spark, [(1, "a b c"), (2, "a\x0bb"), (3, ""), (4, None), (4, None)])
    n = token_counts.count_tokens(F.col("text"), "space/1")
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    load = token_counts.change(df, "insert", "space/1", n)
    assert rollup.commit("b1", load) and not rollup.commit("b1", load)
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "space/1", 5, 5)]
    assert rollup.commit("b2", token_counts.change(df.where("doc_id = 1"), "revise", "space/1", n * 10, n))
    assert rollup.commit("b3", token_counts.change(df.where("doc_id = 2"), "delete", "space/1", n))
    assert rollup.commit("b4", load.limit(0))
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "space/1", 4, 30)]
    with pytest.raises(Exception, match="unknown operation"):
        rollup.commit("b5", token_counts.change(df, "upsert", "space/1", n))
    assert not rollup.committed("b5")


def test_folds_and_lost_writers(spark, tmp_path):
    df = docs(spark, [(1, "a b c"), (2, "d")])
    n = token_counts.count_tokens(F.col("text"), "space/1")
    load = token_counts.change(df, "insert", "space/1", n)
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"), fold=3)
    told = lambda: [tuple(r) for r in rollup.totals().collect()]
    assert told() == []
    for k in range(1, 8):
        assert rollup.commit(f"b{k}", load) and not rollup.commit(f"b{k}", load)
        assert told() == [("s", "en", "space/1", 2 * k, 4 * k)]
    assert len(list((tmp_path / "r" / "bases").iterdir())) == 2
    # A writer that died leaves sums without a mark; two writers of one batch leave two finished attempts.
    batch = lambda name: tmp_path / "r" / "batches" / rollup._named(name)
    token_counts.signed(load).write.parquet(str(batch("b8") / "x"))
    (batch("b8") / "x" / "_SUCCESS").unlink()
    assert not rollup.committed("b8") and told()[0][3] == 14
    for name in ("y", "z"):
        token_counts.signed(load).write.parquet(str(batch("b9") / name))
    assert told() == [("s", "en", "space/1", 16, 32)]
    # A fold that died before its list was written is no base.
    (tmp_path / "r" / "bases" / "000000000009-x" / "sums").mkdir(parents=True)
    rollup.fold()
    rollup.vacuum()
    assert told() == [("s", "en", "space/1", 16, 32)] and not rollup.commit("b3", load) and not batch("b3").exists()
    assert rollup.commit("b8", load) and told()[0][3] == 18


def test_a_rollup_counts_with_a_real_tokenizer(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    from tracewell.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = ["a plain text", "", None, "é" * 300, "x\n\n  y" * 50]
    rows = token_counts.count_bpe(docs(spark, list(enumerate(texts))), path, public_tokenizers.PATTERN)
    assert {r.doc_id: r.n_tokens for r in rows.collect()} == {i: len(codec.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    rollup.commit("load", token_counts.change(rows, "insert", "byte_bpe_50k/1", F.col("n_tokens")))
    rollup.commit("retokenized", token_counts.change(rows, "revise", "byte_bpe_50k/1", F.octet_length(F.coalesce("text", F.lit(""))), F.col("n_tokens")))
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "byte_bpe_50k/1", 5, sum(len((t or "").encode()) for t in texts))]
