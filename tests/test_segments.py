"""Paragraphs against a parser that goes from line to line."""

import random
import re

from vellum.operators import segments as sg
from vellum.sources.tableset import TableSet


def parsed(text, form):
    """(title, sections, [(section, text)])"""
    title, sections, section, out, para = "", [], "Preamble", [], []

    def end():
        if para:
            out.append((section, " ".join(para)))
            para.clear()

    for line in (text or "").split("\n"):
        line = line.strip()
        if form == "markdown":
            m = re.match(r"(#{1,6})\s+(.+)$", line)
            heading = m and m[2].strip()
            if m and m[1] == "#" and not title and not out and not para:
                title = heading
                continue
        else:
            m = re.match(r"\\(?:sub){0,2}section\*?\{\s*([^}]+)\s*\}", line)
            heading = m and m[1].strip()
            if not m and line.startswith("\\title"):
                t = re.search(r"\\title\*?\{([^}]+)\}", line)
                title = t[1].strip() if t else title
                continue
            if not m and line.startswith(("\\begin", "\\end", "\\label", "%")):
                continue
        if m or not line:
            end()
            if m:
                section = heading
                sections += [heading] * (heading not in sections)
        else:
            para.append(line)
    end()
    return title, sections, out


MARKDOWN = ["# One", "# Two ", "## Method", "### Method", "#no header", "####### seven", "", "  ", "text a", "  text b\t", "#", "ünï  code", "\u00a0"]
LATEX = ["\\section{A}", "\\subsection*{ B b }", "\\subsubsection{C} tail", "\\section{}", "\\title{T one}", "\\title*{T two} x", "\\titlepage", "\\begin{a}", "\\end{a}", "% note", "\\label{x}", "", "text", " more text", "\\textbf{z}"]


def test_made_documents(spark):
    dice = random.Random(8)
    for form, pool in (("markdown", MARKDOWN), ("latex", LATEX)):
        texts = ["\n".join(dice.choices(pool, k=dice.randrange(25))) for _ in range(120)] + [None, "", "\n\n", "# Only a title", "one line", "## H\r\ntext\r\n", "\n".join(pool * 40)]
        docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, section string")
        for width in (3, 1 << 20):
            got = {i: [] for i in range(len(texts))}
            for r in sorted(sg.paragraphs(docs, form, width=width).collect()):
                got[r.doc_id].append((r.section, r.text))
                assert r.paragraph_index == len(got[r.doc_id])
            lines = {r.doc_id: (r.title, r.sections) for r in sg.outlines(docs, form, width=width).collect()}
            for i, t in enumerate(texts):
                title, sections, want = parsed(t, form)
                assert got[i] == want, t
                assert lines[i] == (title, sections), t
        assert sg.paragraphs(docs.limit(0), form).count() == 0 and sg.outlines(docs.limit(0), form).count() == 0


def test_xml(spark):
    far = "x" * 400
    texts = [
        '<sec title="A"><p>one</p><P>two <b>bold</b>\nline</P></sec><sec id="2" title=\'B\'><p> </p><p>three</p>',
        f'<sec title="A">{far}<p>none in reach</p><p></p>',
        "<p>no end",
        None,
        "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, sg.xml_paragraphs(docs).collect()))
    assert got == [(0, 1, "A", "one"), (0, 2, "A", "two bold\nline"), (0, 3, "B", "three"), (1, 1, "Preamble", "none in reach")]


def test_stored_paragraphs_are_replaced(spark, tmp_path):
    tables = TableSet(spark, f"file://{tmp_path}/set", {"chunks": ("paper_id",)})
    store = lambda name, rows: sg.store_paragraphs(tables, name, d := spark.createDataFrame(rows, "paper_id string, text string"), sg.paragraphs(d, "markdown", "paper_id"))
    store("one", [("a", "x\n\ny"), ("b", "z")])
    store("two", [("a", "new"), ("c", "")])
    assert sorted((r.paper_id, r.text) for r in tables.read("chunks").collect()) == [("a", "new"), ("b", "z")]


def test_line_formats_move_no_lines(spark):
    docs = spark.createDataFrame([(1, "# A\n\nx\n## B\ny\nTz"), (2, "\\section{A}\nTb\nHc\n\nBd"), (3, None)], "doc_id bigint, text string")
    for form in ("markdown", "latex"):
        for found in (sg.paragraphs(docs, form), sg.outlines(docs, form)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Window" not in plan
    assert [r[2:] for r in sorted(sg.paragraphs(docs, "latex").collect()) if r[0] == 2] == [("A", "Tb Hc"), ("A", "Bd")]
