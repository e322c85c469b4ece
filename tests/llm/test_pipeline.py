"""The pipeline on a small corpus: every stage keeps columns, and its decisions hold."""

import hashlib
import math
import random
import re

import regex
from test_native import WORD, base_counts, goals, plain_em
from test_near_dup import brute
from test_odd_cases import plain_features
from tokenizers import Tokenizer

import corpus_pipeline
from cytoframe.llm import quality_model, quality_rules
from cytoframe.llm.settings import tokenizer_path


def test_stages(spark, tmp_path):
    r = random.Random(1)
    word = lambda: "".join(r.choice("etaoinsh") for _ in range(r.randint(2, 8)))
    rows = []
    for i in range(300):
        text = " ".join(word() + ("***" if i % 5 == 0 else "") for _ in range(60))
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(1000 + i, rows[1][1], "en", "s1", rows[1][4]) for i in range(20)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    d = str(tmp_path)
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{d}/out{k}")
        new = spark.read.parquet(f"{d}/out{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert new.columns == docs.columns
        ids = {x.doc_id for x in new.select("doc_id").collect()}
        if k == 1:
            assert ids == {x[0] for x in rows if x[0] % 5 or x[0] >= 300}
        if k == 2:
            assert ids == {x[0] for x in rows if x[0] % 5 and x[0] < 300}
        names.append(name)
        docs = new
    assert len(names) == 5 and "n_tokens" in docs.columns
    assert docs.count() == corpus_pipeline.run(spark, d).count()


def quality_of(model, texts):
    """Score of each text by looking up tables one by one."""
    out = []
    for t in texts:
        bins = [sum(e <= v for e in edges) for v, edges in zip(plain_features(t), model.edges)]
        z = model.bias + sum(float(model.single[j][b]) for j, b in enumerate(bins)) + sum(float(table[bins[j], bins[k]]) for (j, k), table in zip(model.pairs, model.tables))
        out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
    return out


def rule_votes(t):
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n_words, word_chars, n_symbols, n_dup, n_repeat = base_counts(t)
    value = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "n_lines": len(lines), "n_capitals": sum("A" <= c <= "Z" for c in t), "n_shouts": t.count("!"),
        "n_stutters": sum(a == b for a, b in zip(w, w[1:])), "n_distinct": len(set(w)), "n_symbol_runs": len(re.findall(r"[#*$%&|<>]+", t)), "n_odd_ends": len(regex.findall(quality_rules.ODD_END, t)), "20": 20, "pow(n_words, 0.75)": n_words**0.75,
    }
    return value, tuple(0 if value[a] > value[b] * bad else 2 if value[a] <= value[b] * good else 1 for _, a, b, good, bad in quality_rules.RULES)


def mixed(rows):
    """The mix of (doc_id, text, source), by ranking all quotients."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows if s is not None}) + [None] * any(s is None for *_, s in rows)
    sizes = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in sources}
    target, total = goals(sizes), sum(size)
    best = sorted(((-(target[s] / (2 * k + 1)), i, k) for i, s in enumerate(sources) for k in range(int(target[s]) + 3) if target[s]))[:total]
    out = []
    for i, s in enumerate(sources):
        want = min(sum(b[1] == i for b in best), 3 * sizes[s])
        own = sorted((hashlib.md5(f"mix-1|{'' if d is None else d}|{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest(), d, n, t) for (d, t, k), n in zip(rows, size) if k == s and n)
        upto = 0
        for _, d, n, t in own:
            taken = n * (want // sizes[s]) + max(0, min(upto + n, want % sizes[s]) - upto)
            upto += n
            out += [(d, t, s)] * math.floor(taken / n + 0.5)
    return out


def test_every_stage_by_brute_force(spark, tmp_path):
    r = random.Random(12)
    word = lambda: "".join(r.choice("etaoinsh") for _ in range(r.randint(2, 8)))
    kinds = [lambda w: w + "***", lambda w: w + " |", lambda w: w] + [lambda w: w] * 5
    rows = []
    for i in range(260):
        kind = r.choice(kinds)
        rows.append((i, " ".join(kind(word()) for _ in range(r.choice([5, 30, 60, 120]))), r.choice(["a", "a", "a", "b", "c", None])))
    for i in range(60):  # near and exact copies
        w = rows[i][1].split(" ")
        if i % 2:
            w[r.randrange(len(w))] = word()
        rows.append((500 + i, " ".join(w), rows[i][2]))
    rows += [(900, None, "a"), (901, "", "b"), (902, " \n ", None)]
    labels = [(i, int("***" not in t and "|" not in t)) for i, t, _ in rows[:200]]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = quality_model.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    plain = rows
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{d}/brute{k}")
        docs = spark.read.parquet(f"{d}/brute{k}")
        if k == 0:
            plain = [x for x, s in zip(plain, quality_of(model, [t for _, t, _ in plain])) if s >= quality_model.THRESHOLD]
        elif k == 1:
            judged = [(x, *rule_votes(x[1] or "")) for x in plain]
            fit = [j for j in judged if not (j[1]["n_words"] < 20 or 100 * j[1]["n_repeat_words"] > 30 * j[1]["n_words"])]
            plain = [x for (x, *_), p in zip(fit, plain_em([v for *_, v in fit])) if p >= 0.5]
        elif k == 2:
            kept = {i for i, n, _, stays in brute([(i, t) for i, t, _ in plain]) if stays or not n}
            plain = [x for x in plain if str(x[0]) in kept]
        elif k == 3:
            plain = mixed(plain)
        if k < 4:
            assert sorted(map(str, plain)) == sorted(str((x.doc_id, x.text, x.source)) for x in docs.collect()), k
            assert len(plain) > 50
    want = []
    for i, t, s in plain:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        code = b"".join(x.to_bytes(4, "little") for x in ids)
        want.append((i, s, len(ids), hashlib.sha256(code).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(x)) for x in docs.collect())


def test_odd_tables(spark, tmp_path):
    """Nulls in every column, blank and very long texts, repeated rows and ids, clashing columns; and nothing at all."""
    r = random.Random(2)
    good = " ".join("".join(r.choice("etaoinsh") for _ in range(5)) for _ in range(40))
    rows = [(i, good + f" {i} " + good[::-1], "en", "s", i) for i in range(30)] + [(None, None, None, None, None), (None, good, None, None, 1), (3, "", "en", "s", None), (4, good, "en", None, 2), (4, good, "en", None, 2), (5, "long words go on " * 40_000, "en", "s", 3)]
    schema = "doc_id long, text string, lang string, source string, n_tokens int"
    for name, some in (("odd", rows), ("none", [])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame([(*x, 1, 2) for x in some], schema + ", score int, kept int").write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(9)] + [(None, None, None)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        got = corpus_pipeline.run(spark, d)
        assert got.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert bool(got.collect()) == bool(some)
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:4]:
            assert stage(spark, docs, d).columns == docs.columns
