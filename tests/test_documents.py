"""Sections, chunks, formulas, tables and images against small independent models."""

import random
import re

import pytest
from hypothesis import given, settings as hypothesis_settings, strategies as st
from pyspark.sql import functions as F

from marlstone.config import IngestSettings
from marlstone.functions import formula
from marlstone.functions.tables import linearize
from marlstone.operators import images
from marlstone.operators.chunks import chunk_documents
from marlstone.operators.sections import heading_sections

SMALL = IngestSettings(min_content_length=60, max_content_length=160)


def model_sections(md, file_title):
    """Line-by-line model of the heading tree."""
    out, stack, body, title, level, code = [], {}, [], "", 0, False

    def close():
        text = "\n".join(body).strip()
        if text:
            titles = [stack[k] for k in sorted(stack) if k <= level and stack[k]]
            shown = title or file_title
            parents = [stack[k] for k in sorted(stack) if k < level and stack[k]]
            out.append((shown, parents[-1] if parents and level > 1 else shown, " > ".join(titles) or shown, text))

    for line in md.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if re.match(r"^\s*```", line):
            code = not code
        found = re.match(r"^\s*(#{1,6})\s+(.+)", line)
        if found and not code:
            close()
            title, level, body = found.group(2).strip(), len(found.group(1)), []
            stack = {k: v for k, v in stack.items() if k < level}
            stack[level] = title
        else:
            body.append(line)
    close()
    return out


def model_chunks(md, file_title, low, high):
    pieces = []
    for title, parent, path, body in model_sections(md, file_title):
        body = linearize(body)
        short = title[:80]
        room = high - len(short) - 2
        if len(body) <= room or room <= 0:
            pieces.append([title, parent, title, path, body])
        else:
            for i, part in enumerate(formula.split_around_formulas(body, room)):
                pieces.append([f"{short}_{i + 1}", parent, title, path, part])
    merged = []
    for piece in pieces:
        last = merged[-1] if merged else None
        if (
            last
            and last[3] == piece[3]
            and len(last[0]) + 2 + len(last[4]) < low
            and len(last[1]) + 2 + len(last[4].rstrip()) + 2 + len(piece[4]) <= high
        ):
            last[4] = last[4].rstrip() + "\n\n" + piece[4]
            last[0] = last[2]
        else:
            merged.append(list(piece))
    return [f"{t}\n\n{b}" for t, _p, _s, _path, b in merged]


def random_markdown(seed):
    rng = random.Random(seed)
    lines = []
    for _ in range(rng.randint(1, 60)):
        kind = rng.random()
        if kind < 0.18:
            lines.append("#" * rng.randint(1, 7) + rng.choice([" ", "  ", ""]) + rng.choice(["A", "B", "C d", "", "E"]))
        elif kind < 0.26:
            lines.append(rng.choice(["```", "  ```py", "```"]))
        elif kind < 0.34:
            lines.append("")
        elif kind < 0.40:
            lines.append("formula $x_" + str(rng.randint(1, 9)) + "=1$ and \\(y\\)")
        elif kind < 0.44:
            lines += ["| a | b |", "|---|---|", f"| {rng.randint(1, 9)} | v |"]
        else:
            lines.append(" ".join(rng.choice(["alpha", "beta", "gamma。", "delta"]) for _ in range(rng.randint(1, 14))))
    return rng.choice(["\n", "\r\n"]).join(lines)


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, f"File {i % 3}", random_markdown(i)) for i in range(40)]
    return rows, spark.createDataFrame(rows, "doc_key long, file_title string, content string")


def test_heading_tree_matches_model(documents):
    rows, df = documents
    got = {}
    for r in heading_sections(df).orderBy("doc_key", "sec_no").collect():
        got.setdefault(r.doc_key, []).append((r.title, r.parent_title, r.section_path, r.body))
    for key, title, md in rows:
        assert got.get(key, []) == model_sections(md, title), md


def test_chunks_match_model(documents):
    rows, df = documents
    got = {}
    for r in chunk_documents(df, settings=SMALL).orderBy("doc_key", "chunk_index").collect():
        got.setdefault(r.doc_key, []).append(r.content)
    for key, title, md in rows:
        assert got.get(key, []) == model_chunks(md, title, 60, 160), md


def test_chunk_numbers_are_dense(documents):
    _rows, df = documents
    chunks = chunk_documents(df, settings=SMALL).collect()
    for key in {c.doc_key for c in chunks}:
        mine = [c for c in chunks if c.doc_key == key]
        assert sorted(c.chunk_index for c in mine) == list(range(len(mine)))
        for section in {c.section_id for c in mine}:
            assert sorted(c.section_chunk_index for c in mine if c.section_id == section) == list(
                range(sum(c.section_id == section for c in mine))
            )


@hypothesis_settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 。\n$\\x=", max_size=120), st.integers(1, 30))
def test_splitting_loses_nothing_and_keeps_formulas(text, size):
    pieces = formula.split_around_formulas(text, size)
    squeeze = lambda t: re.sub(r"\s+", "", t)
    assert squeeze("".join(pieces)) == squeeze(text)
    for start, end, _display in formula.spans(text):
        raw = text[start:end]
        assert any(raw.strip() in piece for piece in pieces)


@hypothesis_settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab 。，\n", max_size=200), st.integers(1, 40))
def test_plain_pieces_fit_and_join(text, size):
    pieces = list(formula.plain_pieces(text, size))
    assert "".join(pieces) == text
    assert all(len(p) <= size for p in pieces)


def test_formula_forms_and_words(spark):
    md = r"a $x_1+y$ b $$\begin{align}a&=b\end{align}$$ \[q\] \(z\) price $5 \begin{cases}1\end{cases}"
    df = spark.createDataFrame([(md,), ("plain",), (None,)], "t string")
    rows = df.select(formula.formulas(F.col("t")).alias("f")).collect()
    assert [(f.raw, f.display) for f in rows[0].f] == [
        ("$x_1+y$", False),
        (r"$$\begin{align}a&=b\end{align}$$", True),
        (r"\[q\]", True),
        (r"\(z\)", False),
        (r"\begin{cases}1\end{cases}", True),
    ]
    assert formula.keywords(r"\frac{a_1}{b} + \alpha \unknown x") == "fraction division 分数 除法；alpha 阿尔法；变量符号 a_1 b x"
    text = df.select(formula.search_text(formula.formulas(F.col("t"))).alias("s")).head().s
    assert text.startswith("公式1；类型：行内公式；LaTeX：x_1+y；检索语义：变量符号 x_1 y\n公式2；类型：块级公式")


@pytest.mark.parametrize(
    "source, expected",
    [
        ("<table><tr><td>k</td><td></td></tr><tr><td></td><td>v</td></tr></table>", "\n\n- 【k】：无。\n- 【未知属性】：v。\n\n"),
        (
            "<table><tr><th></th><th colspan=2>h</th></tr><tr><td rowspan=2>a</td><td>1</td><td>/</td></tr><tr><td>2</td></tr></table>",
            "\n\n- 【a】：h为1。\n- 【a】：h为2。\n\n",
        ),
        ("| n | v |\n|---|:-:|\n| a | $x|y$ |\n| b | - |\n| | 3 |\n", "\n\n- 【a】(对应n)：v为$x|y$。\n- 【b】\n- 【未知项目】(对应n)：v为3。\n\n"),
        ("no table | here", "no table | here"),
    ],
)
def test_tables_become_sentences(source, expected):
    assert linearize(source) == expected


def test_image_context_and_links(spark):
    md = "# T\n\nfar\n\nnear one\nnear two\n\n![old](images/a.png)\nafter\n\nmore\n## U\nx\n```\n![no](images/a.png)\n```\n![b](b.jpg) ![c](c.txt)"
    docs = spark.createDataFrame([(1, md), (2, "none")], "doc_key long, content string")
    files = spark.createDataFrame([(1, "a.png"), (1, "b.jpg"), (1, "c.txt")], "doc_key long, image_name string")
    rows = images.image_contexts(docs, files, settings=IngestSettings(img_content_length=5)).orderBy("pos").collect()
    assert [(r.image_name, r.pos, r.above_title, r.above, r.following) for r in rows] == [
        ("a.png", 7, "T", "near one\nnear two", "after"),
        ("b.jpg", 16, "U", "## U\nx\n```\n\n```", ""),
    ]
    stored = spark.createDataFrame(
        [(1, "a.png", "http://s/a.png", "A picture"), (1, "b.jpg", "http://s/b.jpg", None)],
        "doc_key long, image_name string, url string, summary string",
    )
    new = {r.doc_key: r.content for r in images.replace_images(docs, stored).collect()}
    assert new[2] == "none"
    assert new[1] == md.replace("![old](images/a.png)", "![A picture](http://s/a.png)", 1).replace("![b](b.jpg)", "![b](http://s/b.jpg)")
