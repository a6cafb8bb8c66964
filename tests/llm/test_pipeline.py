"""The pipeline against plain Python, on documents written for it."""

import os
import random
import re
import uuid
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as CP
from payrecheck.llm import pieces
from payrecheck.llm.queries import ORACLES, QUERIES
from payrecheck.session import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents():
    rng = random.Random(8)
    word = lambda: rng.choice("bcdfghjklm") + rng.choice("aeiou") + rng.choice("nprst") + rng.choice("aeiou")
    words = lambda n: [word() for _ in range(n)]
    items = [(k, " ".join(words(rng.randint(12, 40)))) for k in range(5)]
    docs = []
    for _ in range(60):
        w = words(rng.randint(20, 160))
        lines = [" ".join(w[k : k + 12]) for k in range(0, len(w), 12)]
        if rng.random() < 0.4:
            lines.insert(rng.randint(0, len(lines)), "Home | About | Contact")
        docs.append("\n".join(lines))
    for k in range(0, 30, 3):
        docs += [docs[k]] * rng.choice([1, 4])
        w = docs[k + 1].split(" ")
        w[len(w) // 2] = "changed"
        docs.append(" ".join(w))
    for k, item in items:
        docs.append(docs[40 + k] + "\n" + item)
    docs += ["too short", None, "", " ".join(["again and again the same"] * 30)]
    rng.shuffle(docs)
    rows = [(k, t, "en", rng.choice(["x", "x", "y"]), len(t or "")) for k, t in enumerate(docs)]
    return rows, items


def grams(w, n):
    return [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]


def brute(rows, items):
    """doc_id of the rows that stay, with their texts."""
    def frequent(norm):
        pages, held = defaultdict(set), defaultdict(set)
        for _, t, host in rows:
            pages[host].add(t or "")
        for host, texts in pages.items():
            for t in texts:
                for x in filter(WORD.search, t.split("\n")):
                    held[host, norm(x)].add(t)
        return {k for k, v in held.items() if len(v) >= 5 and len(v) > 0.1 * len(pages[k[0]])}

    rows = [(d, t, s) for d, t, _, s, _ in rows]
    norm = lambda x: re.sub("0+", "0", re.sub("[0-9]", "0", " ".join(x.lower().split())))
    often, kept = frequent(norm), []
    for d, t, s in rows:
        w = WORD.findall(t or "")
        count = Counter(grams(w, 5))
        again = {p for k, g in enumerate(grams(w, 5)) if count[g] > 1 for p in range(k, k + 5)}
        left = len(w) - sum(len(WORD.findall(x)) for x in (t or "").split("\n") if WORD.search(x) and (s, norm(x)) in often)
        if len(w) >= 10 and 100 * len(again) <= 20 * len(w) and left >= max(10, 0.5 * len(w)):
            kept.append((d, t, s))
    rows = kept
    often = frequent(str.strip)
    rows = [(d, "\n".join(x for x in t.split("\n") if not (WORD.search(x) and (s, x.strip()) in often)), s) for d, t, s in rows]
    sets = {d: set(grams(WORD.findall(t.lower()), 5) or [tuple(WORD.findall(t.lower()))]) for d, t, _ in rows}
    gone, at = set(), {d: d for d in sets}
    ids = sorted(sets)
    for _ in ids:
        for a in ids:
            for b in ids:
                if a < b and at[a] != at[b] and len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b]):
                    at[a] = at[b] = min(at[a], at[b])
                    gone.add(b)
        if all(at[a] == at[b] for a in ids for b in ids if a < b and len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b])):
            break
    rows = [(d, t) for d, t, _ in rows if at[d] == d]
    out = {}
    for d, t in rows:
        w = WORD.findall(t.lower())
        leak = False
        for _, i in items:
            v = WORD.findall(i.lower())
            for p in range(len(w) - len(v) + 1):
                a, b = Counter(grams(w[p : p + len(v)], 5)), Counter(grams(v, 5))
                leak |= (a & b).total() >= 0.8 * (a | b).total()
        if not leak:
            out[d] = t
    return out


@pytest.mark.skipif(not os.path.exists(pieces.MODEL_PATH), reason="no vocabulary here")
def test_pipeline_equals_plain_python(spark):
    from sentencepiece import SentencePieceProcessor

    rows, items = documents()
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    want = brute(rows, items)
    p = SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    got = {r.doc_id: r for r in CP.run(spark, folder).collect()}
    assert sorted(got) == sorted(want)
    assert all(got[d].ids == p.encode(t) and got[d].round_trip for d, t in want.items())
    assert 20 < len(want) < len(rows) - 20


def test_stages_keep_the_columns_and_follow_the_list():
    assert [n for n, _ in CP.STAGES] == [
        "quality rules", "line dedup", "n-gram jaccard join", "benchmark decontamination",
        "sentencepiece encoding and decoding",
    ]
    assert {q.split("_")[0] for q in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(ORACLES) == {"op2_site_lines", "op9_quality_rules", "op12_merkle_manifest"}


def test_line_dedup_with_columns_called_as_its_own(spark):
    import corpus_pipeline as C

    kind = "doc_id long, text string, lang string, source string, n_chars long, n_dropped int, n_lines int"
    rows = [(k, f"own words {k}\nshared boiler plate line", "en", "s", 9, -1, -2) for k in range(30)]
    rows += [(99, None, None, None, None, -1, -2)]
    got = C.line_dedup(spark, spark.createDataFrame(rows, kind), "")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_dropped", "n_lines"]
    for r in got.collect():
        assert (r.n_dropped, r.n_lines) == (-1, -2)
        assert (r.text, r.n_chars) == (
            (None, None) if r.doc_id == 99 else (f"own words {r.doc_id}", len(f"own words {r.doc_id}"))
        )
