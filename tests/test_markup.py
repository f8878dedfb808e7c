import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from revlens.functions import markup as M
from revlens.functions import rendered
from revlens.plans import queries as own


def kinds(text):
    return [(k, t) for k, t in M.wiki_pieces(text) if k not in ("space", "newline", "par_break")]


def test_atomic_tags():
    assert kinds("see [[Some page|its [[inner]] name]] now") == [("word", "see"), ("tag", "[[Some page|its [[inner]] name]]"), ("word", "now")]
    assert kinds("{{box|{{small}}}} <ref name=x>a b</ref> <br/> [http://x.org an x]") == [("tag", "{{box|{{small}}}}"), ("tag", "<ref name=x>a b</ref>"), ("tag", "<br/>"), ("tag", "[http://x.org an x]")]
    # what never closes is plain; a tag without an end stands alone
    assert kinds("[[open ended <b>bold") == [("word", "[[open"), ("word", "ended"), ("tag", "<b>"), ("word", "bold")]
    assert kinds("#redirect [[Other]]") == [("redirect", "#redirect [[Other]]")]


def test_lines_titles_and_tables():
    text = "== Head ==\n* item one\n indented\n{| class=x\n|-\n| a || style=s | b\n|}\n|+ cap"
    assert kinds(text) == [
        ("title_start", "\n=="), ("word", "Head"), ("title_end", "=="), ("bullet", "\n* "), ("word", "item"), ("word", "one"), ("indent", "\n "), ("word", "indented"),
        ("table_line", "\n{| class=x"), ("table_line", "\n|-"), ("table_cell", "\n|"), ("word", "a"), ("table_cell", "|| style=s |"), ("word", "b"), ("table_line", "\n|}"), ("table_caption", "\n|+ "), ("word", "cap"),
    ]


def test_words_marks_and_edges(spark):
    rows = [(1, "{{#t:4,12,ann}}The ''Big'' Dog.{{#t:7,,bob}} ran&nbsp;on &lt;!-- hidden --&gt;."), (2, None), (3, ""), (4, "x" * 1_000_001)]
    pieces = spark.createDataFrame(rows, "k int, text string").select("k", M.wiki_words(F.col("text")).alias("pieces"))
    got = {r["k"]: [(p["word"], p["trust"], p["origin"], p["author"]) for p in r["pieces"] if p["word"] is not None] for r in pieces.collect()}
    ann, bob = (4.0, 12, "ann"), (7.0, 0, "bob")
    assert got[1] == [("the", *ann), ("big", *ann), ("dog", *ann), ("ran", *bob), ("&nbsp;", *bob), ("on", *bob)]
    assert got[2] == got[3] == got[4] == []
    text = pieces.where("k = 1").select(M.marked_text(F.col("pieces")).alias("t")).first()["t"]
    assert text.count("{{#t:") == 2 and text.strip().startswith("{{#t:4,12,ann}}The")


def test_sections(spark):
    rows = [(1, "intro words\n\n== Title ==\nbody\n* one\n* two")]
    pieces = spark.createDataFrame(rows, "k int, text string").select("k", M.wiki_words(F.col("text")).alias("pieces"))
    got = [(r["word"].strip(), r["section"]) for r in M.sections(pieces, "k").orderBy("at").collect()]
    first = got[0][1]
    assert [(w, s - first) for w, s in got] == [("intro", 0), ("words", 0), ("==", 2), ("title", 2), ("==", 2), ("body", 3), ("*", 4), ("one", 4), ("*", 5), ("two", 5)]


MARKUP = "Intro ''words'' here\n\n== Title ==\n* item one [[link|text]] after\n indented\n{| class=x\n| a || b\n|}\nlast &nbsp; {{box}}"


def test_marks_come_back_from_the_coloured_text(spark):
    words = [w for k, t in M.wiki_pieces(MARKUP) if k in M._WORDS for w in [M._WORDS[k](t)]]
    n = len(words)
    trust, origin, author = [float(k % 4) for k in range(n)], [100 + k // 3 for k in range(n)], [k // 5 for k in range(n)]
    df = spark.createDataFrame([(MARKUP, trust, origin, author), (None, [], [], []), ("", [], [], [])], "text string, trust array<double>, origin array<long>, author array<long>")
    told = df.select("text", M.coloured_markup("text", "trust", "origin", "author").alias("marked"), M.visible_words("text").alias("words"))
    rows = told.select("*", M.wiki_words(F.col("marked")).alias("again")).collect()
    assert rows[0]["words"] == words and rows[1]["marked"] == "" == rows[2]["marked"]
    again = [(p["word"], p["trust"], p["origin"], p["author"]) for p in rows[0]["again"] if p["word"] is not None]
    assert [w for w, *_ in again] == words
    # a mark holds from what follows it: words and tags get their own back; what only opens or closes a line has that of the mark before
    kinds = [k for k, _ in M.wiki_pieces(MARKUP) if k in M._WORDS]
    for k, (kind, (_, t, o, a)) in enumerate(zip(kinds, again)):
        if kind in ("word", "tag"):
            assert (t, o, a) == (trust[k], origin[k], str(author[k]))
    assert M.annotated("a b", [0.4, 0.6], [1, 1], [2, 2], origins=False, authors=False) == "a {{#t:1,,}}b"
    assert M.annotated("one [[x]] two", [2.0, 2.0, 2.0], [1, 1, 1], [7, 7, 7]) == "{{#t:2,1,7}}one {{#t:2,1,7}}[[x]]{{#t:2,1,7}} two"


def test_long_texts_are_read_block_by_block():
    text = " ".join(f"word{k}" for k in range(30_000))
    blocks = M.text_blocks(text)
    assert "".join(blocks) == text and len(blocks) == 3 and all(M.BLOCK_CHARS < len(b) <= M.BLOCK_CHARS + M.BLOCK_LOOKS and b.endswith(" ") for b in blocks[:-1])
    assert [t for k, t in M.block_pieces(text) if k == "word"] == text.split()
    # without a blank in sight the cut goes through a word; markup across a border is none
    solid = "y" * 250_000
    assert [len(b) for b in M.text_blocks(solid)] == [100_000, 100_000, 50_000] and [len(t) for _, t in M.block_pieces(solid)] == [100_000, 100_000, 50_000]
    link = "z" * 99_995 + " [[" + "q" * 2_000 + "]] end"
    assert ("tag", "[[" + "q" * 2_000 + "]]") in M.wiki_pieces(link) and not [k for k, _ in M.block_pieces(link) if k == "tag"]
    assert M.text_blocks("short") == ["short"] and M.block_pieces("= a =") == M.wiki_pieces("= a =")


def test_visible_words_are_those_of_the_pieces():
    r = random.Random(6)
    parts = ["Word", "ÉCOLE", " ", ", ", ".\n", "''", "'''", "&nbsp;", "&amp;#12;", "&x", "\n* ", "\n== ", " ==", "[[a|B]]", "{{t}}", "<b>", "\n| c || d", "{{#t:1,2,x}}", "\n\n", "\n ", "<!-- c -->", "#redirect ", "&lt;", ";", "\u212a"]
    for _ in range(400):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        for disarm in (True, False):
            assert M._visible(text, disarm) == [M._WORDS[k](t) for k, t in M.wiki_pieces(text, disarm) if k in M._WORDS], text


def test_long_pages_are_coloured_whole(spark, tmp_path):
    words = [f"w{k}" for k in range(180_000)]
    html = " ".join(words)
    assert len(html) > M.MOST_CHARS
    spark.createDataFrame([(1, html), (2, "short page")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    digest = {}
    for page, ws in ((1, words), (2, ["short", "page"])):
        marked = " ".join(f"{{{{#t:{i % 10},{i},u{i % 4}}}}}{w}" if i % 9 == 0 else w for i, w in enumerate(ws))
        digest[page] = hashlib.md5(rendered.with_spans(marked, 6.0).encode()).hexdigest()
    assert {r["page_id"]: r["digest"] for r in own.queries()["coloured_pages"](spark, str(tmp_path)).collect()} == digest


def test_visible_words_of_long_texts():
    part = "\n* Item ''one'', [[a|B]] &nbsp;\n== T ==\nlast <b>x</b> &lt;!-- no --&gt;word.\n| c || d\n\n"
    assert M._visible(part * 20_000, True) == M._visible(part, True) * 20_000 and len(part) * 20_000 > M.MOST_CHARS
    plain = "One, two: ''three''&amp; four;\n\tfive" + " x" * 7
    words = ["one", "two", "three", "&amp;", "four", "five"] + ["x"] * 7
    assert M._visible((plain + ". ") * 40_000, False) == words * 40_000
    # one word, and markup that never closes: each opening looked through all the rest before
    assert M._visible("Y" * 1_500_000, True) == ["y" * 1_500_000]
    for opening in ("<!-- ", "<b> ", "!!", "[[", "="):
        text = "x " + opening * 250_000 + "x </i"
        assert "".join(M._visible(text, True)).replace(" ", "") == text.replace(" ", ""), opening


def test_brackets_cells_and_comments_are_those_of_plain_searches():
    r = random.Random(7)
    cell = re.compile(r"(?:\n[|!]|\|\||!!)(?:[^|\n]+\|(?!\|))*")
    comment = re.compile(r"<!--.*?--[ \n\t]*>", re.DOTALL)
    title = re.compile(r"(\n=+)|(=+[ \t]*(?=\n|\Z))|(\n(?:----+)?[ \t]*(?=\n|\Z))")
    for _ in range(2_000):
        text = "".join(r.choice(["|", "!", "\n", "a", " ", "=", "--", "<!--", ">", "]", "[", "]]", "[[", "[http:"]) for _ in range(r.randint(0, 40)))
        assert [(a, b) for _, a, b in M._cells(text)] == [m.span() for m in cell.finditer(text)], text
        assert M._without_comments(text) == comment.sub("", text), text
        assert [m.span() for m in M._TITLES.finditer(text)] == [m.span() for m in title.finditer(text)], text
        for other, _ in M._CLOSES.values():
            ahead, at = M._Ahead(other, text), 0
            while at <= len(text):
                found = list(ahead.looks(at))
                want, place = [], at
                while len(want) < M.MOST_LOOKS and (m := other.search(text, place)):
                    want.append(m.span())
                    place = m.end()
                assert [m.span() for m in found] == want, (text, at)
                at += r.randint(1, 5)


def test_long_pages_have_all_their_sections(spark, tmp_path):
    html = "w " * 300_000 + "\n* item" * 150_000
    assert len(html) > M.MOST_CHARS
    spark.createDataFrame([(1, html), (2, "short\n* page")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r["page_id"], r["section"]): r["n_words"] for r in own.queries()["markup_sections"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0): 300_000, (2, 0): 1, (2, 1): 2} | {(1, k): 2 for k in range(1, 150_001)}
    counted = {r["page_id"]: (r["n_pieces"], r["n_words"]) for r in own.queries()["markup_words"](spark, str(tmp_path)).collect()}
    assert counted == {1: (900_000, 600_000), 2: (3, 3)}
    marked = "{{#t:0,0,}}" + "w " * 300_000 + "\n* {{#t:0,0,}}item" * 150_000
    assert own.queries()["marked_markup"](spark, str(tmp_path)).where("page_id = 1").first()["digest"] == hashlib.md5(marked.encode()).hexdigest()


def test_pieces_of_long_texts_and_their_marks(spark):
    text = "A b, [[c]] ''d''\n== T ==\n* e\n\n" * 40_000
    told = M.wiki_pieces(text)
    assert len(text) > M.MOST_CHARS and "".join(t for _, t in told) == text.replace("''", "")
    words = [w for k, t in told if k in M._WORDS for w in [M._WORDS[k](t)]]
    assert words == ["a", "b", "[[c]]", "d", "\n==", "t", "==\n", "\n*", "e"] * 40_000
    n = len(words)
    marked = M.annotated(text, [3.0] * n, [5] * n, [7] * n)
    assert re.sub(r"\{\{#t:3,5,7\}\}", "", marked) == text.replace("''", "") and marked.count("{{#t:") > 40_000
    rows = [(1, "{{#t:2.5,1,a}}x {{#t:3,1,a}}y\n* {{#t:0.4,1,}}z"), (2, None), (3, "word " * 250_000)]
    pieces = spark.createDataFrame(rows, "k int, text string").select("k", M.wiki_words(F.col("text"), most=None).alias("pieces"))
    got = {r["k"]: r["t"] for r in pieces.select("k", M.marked_text(F.when(F.col("k") != 2, F.col("pieces"))).alias("t")).collect()}
    # marks that say the same once rounded are one
    assert got == {1: "{{#t:3,1,a}}x y\n* {{#t:3,1,a}}{{#t:0,1,}}z", 2: None, 3: "{{#t:0,0,}}" + "word " * 250_000}


def test_plain_words_of_long_documents(spark, tmp_path):
    texts = ["Word, two. " * 120_000, "y" * 1_500_000, "a " * 500_000, " first: blank", "::colon", " .", "", "one"]
    spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    words = [[w.lower() for w in re.split("[,;.: ]+", t) if w] for t in texts]
    want = {k: (len(w), hashlib.md5(" ".join(w).encode()).hexdigest()) for k, w in enumerate(words)}
    got = {r["doc_id"]: (r["n_words"], r["digest"]) for r in own.queries()["plain_markup_words"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == want == {k: (n, digest) for k, n, digest in con.sql(own.oracle_sql()["plain_markup_words"]).fetchall()}
