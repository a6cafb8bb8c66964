"""Line dedup and quality rules against plain Python, and their edge cases."""

import random
import re
from collections import defaultdict

from payrecheck.llm.boilerplate import LineLimits, drop_boilerplate
from payrecheck.llm.quality import QualityLimits, filter_quality, judge_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "cd#", "ef", "é", "x<y", "ghij", "k"]) + rng.choice("qrstuv")
    line = lambda: " ".join(word() for _ in range(rng.randint(0, 12)))
    menu = ["Home  About", " terms of USE 2019", "\tShare\t"]
    docs = []
    for d in range(150):
        host = rng.choice(["a", "a", "a", "b", "c", None])
        lines = [line() for _ in range(rng.randint(0, 8))]
        for m in menu:
            if rng.random() < {"a": 0.5, "b": 0.05}.get(host, 0.3):
                lines.insert(rng.randint(0, len(lines)), m.replace("2019", str(rng.randint(1, 9999))))
        if rng.random() < 0.15 and lines:
            lines += [lines[0]] * rng.randint(1, 3)
        text = rng.choice(["\n", "\n", "\n\n"]).join(lines)
        docs += [(d, text, host, d)] * rng.choice([1, 1, 1, 2])
    docs += [(900, None, "a", 1), (901, "", None, 2), (902, " \n\t", "a", 3), (None, "only words here", "b", 4)]
    docs += [(903, "w " * 30_000, "c", 5), (904, "one two three four five six", "b", 6)]
    return docs


def frequent(docs, norm, share, least):
    pages, held = defaultdict(set), defaultdict(set)
    for _, text, host, _ in docs:
        pages[host or ""].add(text or "")
    for host, texts in pages.items():
        for t in texts:
            for x in t.split("\n"):
                if WORD.search(x):
                    held[host, norm(x)].add(t)
    return {k for k, v in held.items() if len(v) >= least and len(v) > share * len(pages[k[0]])}


KIND = "doc_id long, text string, source string, page int"


def test_line_dedup_equals_plain_python(spark):
    docs = corpus(1)
    trim = lambda x: re.sub(r"[\t\x0b\f\r]", " ", x).strip(" ")
    often = frequent(docs, trim, 0.2, 5)
    assert len(often) >= 3
    want = []
    for d, text, host, page in docs:
        lines = None if text is None else text.split("\n")
        kept = lines and [x for x in lines if not (WORD.search(x) and (host or "", trim(x)) in often)]
        want.append((d, None if text is None else "\n".join(kept), host, page,
                     len(lines or []), len(lines or []) - len(kept or [])))
    frame = spark.createDataFrame(docs, KIND).repartition(3)
    got = [tuple(r) for r in drop_boilerplate(frame, LineLimits(0.2, 5)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(w[5] for w in want) > 20


def stats(text):
    w = WORD.findall(text or "")
    wins = defaultdict(list)
    for k in range(len(w) - 4):
        wins[tuple(w[k : k + 5])].append(k)
    twice = {p for at in wins.values() if len(at) > 1 for k in at for p in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(twice))


def test_quality_equals_plain_python(spark):
    docs = corpus(2)
    norm = lambda x: re.sub(r"0+", "0", re.sub(r"[0-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")))
    limits = QualityLimits(line_share=0.2, line_docs=5)
    often = frequent(docs, norm, 0.2, 5)
    want = []
    for d, text, host, _ in docs:
        s = stats(text)
        gone = sum(len(WORD.findall(x)) for x in (text or "").split("\n")
                   if WORD.search(x) and (host or "", norm(x)) in often)
        failed = s[0] < 10 or 100 * s[4] > 20 * s[0]
        left = s[0] - gone
        want.append((d, text, *s, failed, not failed and left >= 10 and left >= 0.5 * s[0]))
    frame = spark.createDataFrame(docs, KIND).repartition(3)
    columns = ["doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = [tuple(r) for r in judge_quality(frame, limits).select(columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    kept = [tuple(r) for r in filter_quality(frame, limits).collect()]
    passed = [row for row, w in zip(docs, want, strict=True) if w[-1]]
    assert sorted(map(repr, kept)) == sorted(map(repr, passed))
    assert any(not w[-1] and not w[-2] for w in want) and passed


def test_copies_do_not_make_their_lines_boilerplate(spark):
    docs = [(k, "a page with\nits own lines in it and more of them", "h", k) for k in range(40)]
    docs += [(100 + k, f"another page {k} of words that is not like it", "h", k) for k in range(20)]
    frame = spark.createDataFrame(docs, KIND)
    assert {r.n_dropped for r in drop_boilerplate(frame).collect()} == {0}
    # Digits are alike to the rules: the other pages are one page with a counter.
    kept = {r.doc_id for r in filter_quality(frame).collect()}
    assert set(range(40)) <= kept and not kept & set(range(100, 120))


def test_no_rows_and_clashing_names(spark):
    kind = "doc_id long, text string, source string, n_words int, _host int, line string, host string"
    none = spark.createDataFrame([], kind)
    assert filter_quality(none).collect() == [] and filter_quality(none).columns == none.columns
    row = (1, "ten words are in this text so that it can stay", "s", 1, 2, "l", "h")
    assert [tuple(r) for r in filter_quality(spark.createDataFrame([row], kind)).collect()] == [row]
    assert drop_boilerplate(none).collect() == []
    got = drop_boilerplate(spark.createDataFrame([row], kind)).collect()
    assert [tuple(r) for r in got] == [(*row, 1, 0)]
