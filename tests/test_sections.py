"""Chapters and clauses against a reading line by line."""

import random
import re

import pytest

from corpusloom.operators import sections as S


def read(content):
    """Chapters as [number, title, text, [[number, text], ...]]."""
    if content is None:
        return []
    lines, kept, inside, at = content.split("\n"), [], False, 0
    for line in lines:
        low = line.lower()
        if "<table" in low:
            kept.append((at, "<TABLE>"))
            inside = inside if "</table>" in low else True
        elif "</table>" in low:
            inside = False
        elif not inside:
            kept.append((at, line))
        at += len(line) + 1
    h1 = any(re.match(r"#\s+\S", x) for _, x in kept)
    md = any(re.match(r"#{1,3}\s+\S", x) for _, x in kept)
    number = lambda s: (re.match(r"\d+(\.\d+)*", s.strip()) or [None])[0]
    heading = lambda s: re.sub(r"^\d+(\.\d+)*\.?\s*", "", re.sub(r"\*\*(.*?)\*\*", r"\1", s.strip())).strip()
    chapters, open_ = [], None  # open_: [number, texts, chapter, is complete]

    def close():
        nonlocal open_
        if open_ is not None:
            name, texts, chapter = open_
            text = " ".join(t for t in texts if t).strip()
            if text:
                put(chapter, name, text, True)
        open_ = None

    def put(chapter, name, text, merges):
        own = chapter[3]
        if merges and own and own[-1][0] == name and own[-1][2]:
            if text not in own[-1][1] and len(own[-1][1]) < 200:
                own[-1][1] += " " + text[: 200 - len(own[-1][1])]
        else:
            own.append([name, text[:200], merges, False])

    for at, line in kept:
        s = line.strip()
        if not s:
            continue
        level = 1 if h1 else 2
        if re.match("#{%d}\\s+.+$" % level, s):
            close()
            t = re.sub("^#+\\s+", "", s)
            chapters.append([number(t), heading(t), at, []])
            continue
        if not chapters:
            chapters.append([None, "前言", 0, []])
        chapter = chapters[-1]
        if not md:
            if re.match("第[一二三四五六七八九十百]+[部分章节编篇]", s) or (re.match("[一二三四五六七八九十][、.．]", s) and len(s) < 100):
                close()
                if chapter[1] == "前言" and chapter[2] == 0 and not any(x.strip() for a, x in kept if a < at):
                    chapters.pop()
                chapters.append([None, s, at, []])
                continue
            m = re.match(r"（[一二三四五六七八九十]+）\s*(.*)", s)
            if m and len(s) < 100:
                close()
                put(chapter, str(len(chapter[3]) + 1), m[1], False)
                continue
            if len(s) <= 30 and not re.search("[。；：.!?]$", s) and not re.match(r"\d+(\.\d+)*[）).、\s]", s) and not re.search("[，,]", s):
                close()
                put(chapter, str(len(chapter[3]) + 1), s, False)
                continue
        m3 = re.match(r"###\s+.+$", s)
        if m3 or (h1 and re.match(r"##\s+.+$", s)):
            close()
            t = re.sub("^#+\\s+", "", s)
            if m3 and number(t):
                put(chapter, number(t), heading(t), True)
                open_ = [number(t), [], chapter]
            continue
        m = re.match(r"(\d+(?:\.\d+)*)[）).、]\s+(.*)", s) or (re.match(r"(\d+(?:\.\d+)+)\s+(.*)", s) if s[0] not in "<!?" and len(s) < 200 else None)
        if m:
            close()
            open_ = [m[1], [m[2].strip()], chapter]
        elif s == "<TABLE>":
            if chapter[3]:
                chapter[3][-1][3] = True
        elif open_ is not None:
            open_[1].append(s)
    close()
    out = []
    for i, (n, title, at, own) in enumerate(chapters):
        end = chapters[i + 1][2] if i + 1 < len(chapters) else len(content)
        out.append([n, title, content[at:end].strip(), [[k, t.rstrip(" ") + " [包含表格数据]" if tabled else t] for k, t, _, tabled in own]])
    return out


def parsed(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    lines = S.placed(docs)
    chapters = {(r.doc_id, r.chapter): [r.number, r.title, r.text, []] for r in S.chapters(docs, lines).collect()}
    counts = {(r.doc_id, r.chapter): (r.n_clauses, r.clauses) for r in S.chapters(docs, lines).collect()}
    for r in S.clauses(lines).orderBy("doc_id", "chapter", "clause_no").collect():
        chapters[r.doc_id, r.chapter][3].append([r.number, r.text])
    out = [[] for _ in texts]
    for key in sorted(chapters):
        assert counts[key] == (len(chapters[key][3]), [n for n, _ in chapters[key][3]][:10])
        out[key[0]].append(chapters[key])
    return out


FIXED = [
    "intro\n# 1 Title\n## Sub\n### 1.1 First **bold**\nbody one\nbody two\n### 1.1 First\nmore\n1.2 dotted clause\ncont\n1) marked\ntext\n# 2. Next\n2.1 x\n2.1 x y",
    "## 1 总则\n1.1 范围\n内容\n<table>\n<tr><td>1.9 inside</td></tr>\n</table>\n1.2 其他\n<table><tr></tr></table>\nafter",
    "第一章 总则\n（一） 目的\n短标题\n这是一段正文，有逗号的内容。\n二、范围\n1. 概述 内容\n1.1 项目概况\n结尾。", "", None, "   \n\t", "plain prose, with commas and nothing else.\nA second line, likewise.",
    "# Only\n### no number\nlost text\n3.1 kept " + "x" * 300 + "\nmore", "### 1.1 a\n<TABLE>\nbody\n### 2 b", "1.1 a\n\n\n1.1 a\n1.1 b", "# H\n一、 not a chapter here\n（一） nor this",
]


def test_fixed_documents(spark):
    assert parsed(spark, FIXED) == [read(t) for t in FIXED]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_documents(spark, seed):
    rng = random.Random(seed)
    lines = ["# A", "# 2 B **c**", "## 3 C", "## D", "### 1.1 e", "### f", "### 1.1 g", "1.1 h", "1.2 i j", "2) k", "3、 l", "<table>", "</table>", "<table></table>", "", "  ", "words, and more words", "short", "第二章 m", "三、n", "（二）o", "long " * 20 + "." , "1.1", "!x", "x" * 250]
    texts = ["\n".join(rng.choices(lines if i % 3 else lines[7:], k=rng.randint(0, 25))) for i in range(150)]
    got, want = parsed(spark, texts), [read(t) for t in texts]
    for g, w, t in zip(got, want, texts):
        assert g == w, t


def test_outline_and_texts(spark):
    docs = spark.createDataFrame([(1, "# 1 One\n" + "\n".join(f"1.{i} c{i}" for i in range(1, 13)) + "\n# Two\nshort"), (2, "第一章 总则\n" + "很长的正文。" * 40)], "doc_id long, text string")
    found = S.chapters(docs, S.placed(docs))
    got = {r.doc_id: r.outline for r in S.outline(found).collect()}
    assert got == {1: "1 One（12 个条款: 1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9, 1.10...）\n第2章 Two", 2: "第1章 第一章 总则"}
    texts = {(r.doc_id, r.chapter): r.text for r in S.chapter_texts(docs, found).collect()}
    assert texts[1, 1] == "# Two\nshort" and texts[2, 0] == docs.where("doc_id = 2").first().text
    assert texts[1, 0].startswith("One\n1.1 c1") and texts[1, 0].endswith("1.12 c12")  # short, so found by its title


def test_located_and_cut(spark):
    rows = [(0, "intro\n## 第2章 Two\nbody\n第2章 Two", "第2章 Two", 6), (1, "a 第2章 Two\n第2章 Two more", "第2章 Two", 10), (2, "x (y)", "(y)", 2), (3, "x", "", -1), (4, "x", "z", -1)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "id int, s string, n string, want int")
    assert df.where(S.located(F.col("s"), F.col("n"), F.lit(0)) != F.col("want")).count() == 0
    docs = spark.createDataFrame([(1, "zz" * 3000)], "doc_id long, text string")
    found = spark.createDataFrame([(1, 0, None, "A", "short"), (1, 1, None, "B", "short")], "doc_id long, chapter long, number string, title string, text string")
    assert {r.chapter: len(r.text) for r in S.chapter_texts(docs, found).collect()} == {0: 2000, 1: 6000}
