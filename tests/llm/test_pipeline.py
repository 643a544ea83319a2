import random
from collections import Counter

import corpus_pipeline


def tables(spark, path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices(["the", "of", "an", "er", "in", "on", "re", "st"], k=rng.randrange(1, 4)))
    rows, labels = [], []
    for k in range(400):
        w = [word() for _ in range(rng.randrange(30, 120))]
        toxic = k % 5 == 0
        for _ in range(4 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(["nastyword", "vileterm", "grossness"])
        rows.append((k, " ".join(w), "en", f"s{k % 3}"))
        labels.append((k, int(toxic)))
    clean = [r for r in rows if r[0] % 5]
    rows += [(1000 + k, r[1].upper(), "en", "s0") for k, r in enumerate(clean[:40])]  # exact copies
    for k, r in enumerate(clean[40:70]):  # near copies
        w = r[1].split()
        w[-1] = "changed"
        rows.append((2000 + k, " ".join(w), "en", "s1"))
    rows += [(3000, None, "en", None), (3001, "", None, "s0")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs


def test_stages(spark, tmp_path):
    docs = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/out-{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/out-{len(seen)}")
        seen.append(Counter(r.doc_id for r in docs.collect()))
    clean, exact, near, mixed = seen
    toxic = {k for k in range(400) if k % 5 == 0}
    assert len(toxic - set(clean)) > 70 and sum(k in clean for k in range(400) if k % 5) > 300
    assert all(1000 + k in exact for k in range(40) if 1000 + k in clean) and len(exact) <= len(clean) - 35
    assert not any(2000 + k in near for k in range(30) if 2000 + k in exact and [k0 for k0 in range(400) if k0 % 5][40 + k] in exact) and len(near) < len(exact)
    assert max(mixed.values()) <= 2 and set(mixed) <= set(near)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == mixed
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)
