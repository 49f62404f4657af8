"""Line dedup against all pairs of lines."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from crawlscope.llm import line_dedup
from crawlscope.llm.line_dedup import dedup_lines, judge_lines

DOCS = "doc_id long, text string, line_no string, n string"


def tokens(line):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in line)) if w]
    if not words:
        return None, None
    k = min(5, len(words))
    return tuple(words), {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(docs):
    lines = [(d, i, *tokens(line)) for d, t in docs for i, line in enumerate((t or "").split("\n")) if tokens(line)[0]]
    lines.sort(key=lambda x: x[:2])
    first, sets, links = {}, {}, {}
    for d, i, words, s in lines:
        first.setdefault(words, (d, i))
        sets[words] = s
    by_token = {}
    for w, s in sets.items():
        for t in s:
            by_token.setdefault(t, []).append(w)
    for w, s in sets.items():
        near = {o for t in s for o in by_token[t]} - {w}
        links[w] = [o for o in near if 100 * len(s & sets[o]) >= 80 * len(s | sets[o])]
    earlier = {w: {first[o] for o in links[w] if first[o] < first[w]} for w in sets}
    return [((d, i, *first[w], (d, i) != first[w] or bool(earlier[w])), earlier[w]) for d, i, w, _ in lines]


def compare(spark, docs):
    """Verdicts are those of all pairs, and each named earlier line is a similar one; returns the number of verdicts by it."""
    got = judge_lines(spark.createDataFrame([(d, t, "x", "y") for d, t in docs], DOCS)).collect()
    want = dict((x[:2], (x, earlier)) for x, earlier in brute(docs))
    assert sorted((r.doc_id, r.line_no, r.class_doc, r.class_line, r.removed) for r in got) == sorted(x for x, _ in want.values())
    for r in got:
        earlier = want[r.doc_id, r.line_no][1]
        assert (r.similar_doc, r.similar_line) in earlier if earlier else r.similar_doc is None
    return sum(r.similar_doc is not None for r in got)


def test_near_lines(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(60)]
    base = [[random.choice(words) for _ in range(random.choice([1, 3, 5, 8, 20, 45]))] for _ in range(25)]
    docs = []
    for d in range(40):
        lines = []
        for _ in range(random.randrange(0, 8)):
            line = list(random.choice(base))
            for _ in range(random.choice([0, 0, 0, 1, 2])):
                line[random.choice([0, -1, random.randrange(len(line))])] = random.choice(words)
            lines.append(random.choice([" ", "\t", "  "]).join(line).upper() if random.random() < 0.1 else " ".join(line))
        docs.append((d, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, " \n\t\n"), (103, "long " * 30_000 + "\n" + "Long " * 30_000)]
    compare(spark, docs)


def test_family_without_a_leader(spark):
    """Lines that share most of their tokens, few pairs of them similar, none of them the others' origin."""
    random.seed(8)
    core = [f"w{i}" for i in range(60)]
    docs = []
    for d in range(80):
        line = list(core)
        for at in random.sample(range(60), random.choice([1, 1, 2, 3])):
            line[at] = f"x{d}_{at}"
        docs.append((d, " ".join(line)))
    assert 0 < compare(spark, docs) < 80


def test_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    compare(spark, docs)


def test_ties_repeats_and_nulls(spark):
    rows = [(1, "same words here\nsame words here", "a", "b"), (1, "same words here", "a", "b"), (None, "same words here", "a", "b")]
    out = judge_lines(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == 4 and sum(not r.removed for r in out) == 1
    assert {(r.class_doc, r.class_line) for r in out} == {(1, 0)}
    assert judge_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_cleaned_texts(spark):
    rows = [(1, "one line\n\nother line", "a", "b"), (2, "other line\nnew line\none  line", "a", "b"), (3, None, "a", "b"), (4, "One line", "a", "b")]
    out = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == {1: "one line\n\nother line", 2: "new line", 3: None, 4: ""}


def test_cleaned_texts_of_repeated_rows(spark):
    rows = [(1, "one line\nother line", "a", "b")] * 2 + [(2, "third line\nfourth line", "a", "b"), (2, "fifth line\nthird line", "a", "b"), (None, "one line", "a", "b")]
    out = [(r.doc_id, r.text) for r in dedup_lines(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(out, key=str) == sorted([(1, "one line\nother line"), (1, ""), (2, "third line\nfourth line"), (2, "fifth line"), (None, "one line")], key=str)


def links(spark, docs):
    """(class_doc, class_line): (n_links, first similar) of each class by all pairs, and by judge_lines; both as dicts."""
    classes, sets = {}, {}
    for d, t in docs:
        for i, line in enumerate((t or "").split("\n")):
            words, s = tokens(line)
            if words and words not in sets:
                classes[d, i], sets[words] = s, s
    want = {}
    for x, s in classes.items():
        near = [y for y, o in classes.items() if y != x and 100 * len(s & o) >= 80 * len(s | o)]
        want[x] = (len(near), min([y for y in near if y < x], default=(None, None)))
    got = judge_lines(spark.createDataFrame([(d, t, "x", "y") for d, t in docs], DOCS)).collect()
    return want, {(r.class_doc, r.class_line): (r.n_links, (r.similar_doc, r.similar_line)) for r in got}


def test_all_links_are_counted(spark):
    """Families of near lines: alike ones, ones with a word of their own, ones that differ in places, copies and a family just below the threshold."""
    random.seed(14)
    core, other = [f"w{i}" for i in range(60)], [f"v{i}" for i in range(40)]
    docs = [(d, " ".join([*core, f"x{d}"])) for d in range(12)] + [(20 + d, " ".join([f"y{d}", *core[1:]])) for d in range(8)]
    for d in range(40, 80):
        line = list(core)
        for at in random.sample(range(60), random.choice([1, 1, 2, 3])):
            line[at] = f"x{d}_{at % 3}"
        docs.append((d, " ".join(line) + "\n" + " ".join(core[: d - 20])))
    docs += [(80 + d, " ".join([*other, *[f"z{d}_{k}" for k in range(11)]])) for d in range(6)]
    docs += [(90, "a b c d e f\na b c d e f g\nA b  c d e f"), (91, "short line\nSHORT line\nshort lines"), (92, docs[3][1]), (93, None)]
    want, got = links(spark, docs)
    assert got == want
    assert max(n for n, _ in want.values()) > 20


def test_links_of_repeated_rows(spark):
    docs = [(d, " ".join(["a b c d e f g h i j k l m n o p q r s t", f"x{d}"])) for d in range(4)]
    want, got = links(spark, docs + docs)
    assert got == want and {n for n, _ in got.values()} == {3}


def test_few_other_lines_pass_the_filter(spark):
    """Of copies of a line only the one wanted is sure to pass, and of other lines one in thirty may."""
    copies = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("line_no"), F.lit("the same line").alias("line"))
    wanted = copies.where("doc_id % 20 = 0").select("doc_id", "line_no").unionByName(spark.createDataFrame([(None, 3)], "doc_id long, line_no int"))
    lines = copies.unionByName(spark.createDataFrame([(None, 3, "a line")], "doc_id long, line_no int, line string"))
    passed = [r.doc_id for r in line_dedup._may_be_in(lines, wanted, ["doc_id", "line_no"]).collect()]
    assert {None, *range(0, 20_000, 20)} <= set(passed)
    assert len(passed) - 1001 < 19_000 / 20


def test_classes_by_shuffle(spark, monkeypatch):
    """Verdicts where no class is told by broadcast: copies, lines alone in their class and lines with an earlier similar one."""
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 1)
    core = " ".join(f"w{i}" for i in range(30))
    docs = [(d, f"{core} x{d}\nalone {d}\nthe same line\n\n{core} x{d % 3}") for d in range(12)] + [(12, None)]
    assert compare(spark, docs)
    want, got = links(spark, docs)
    assert got == want
