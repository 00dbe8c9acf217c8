import random
import re

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tracewell.llm import bpe

from .test_decontam import brute as hits
from .test_jaccard import brute as groups

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_match_brute_force(spark, tmp_path):
    rnd = random.Random(6)
    say = lambda n: " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(30)) for _ in range(n))
    items = [(i, say(15)) for i in range(5)]
    docs, labels = [], []
    for i in range(300):
        text = say(40)
        if i % 4 == 0:
            text += " vilest" + rnd.choice("aeiou")
        if i % 11 == 0:
            text += " " + items[i % 5][1]
        docs.append((i, text))
        labels.append((i, 1, int(i % 4 == 0)))
    docs += [(1000 + i, t + " x") for i, t in docs[:60]] + [(2000, docs[1][1]), (2001, None), (2002, ""), (1, docs[1][1])]
    d = tmp_path / "sf"
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOC).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    left = [(i, t) for i, t in docs if not re.search("vilest", t or "")]
    comps = groups(left, 5, 80)
    left = [(i, t) for i, t in dict(reversed(left)).items() if any(str(i) == c == x for x, _, c in comps)]
    bad = {i for i, *_, hit in hits(left, items) if hit}
    want = sorted((i, t or "") for i, t in left if i not in bad)

    codec = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = sorted((r.doc_id, codec.decode(r.ids)) for r in corpus_pipeline.run(spark, str(d)).collect())
    assert got == want
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, spark.read.parquet(f"{d}/documents.parquet"), str(d))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    assert [stage(spark, empty, str(d)).count() for _, stage in corpus_pipeline.STAGES] == [0, 0, 0, 0]
