import random
from collections import Counter
from itertools import product

import pytest

from siltstone.llm.markup import Document, Rules, align, bind, clean_markup, expression, gathered, leaves, merge_wrappers, repeats, wrappers
from siltstone.llm.sentences import HiddenEvents, contexts, enclosed, fit, gaps, sentences, word_rows
from siltstone.session import load


def parsed(text):
    d = Document(text, Rules({}))
    return d.found, d.clean()


def test_elements():
    cases = {
        "# Title\n\ntext": {"heading"},
        "Title\n=====\n\ntext": {"heading"},
        "== Title ==\n\n* a\n** b\n": {"heading", "list"},
        "\\section{A}\n\n\\begin{itemize}\n\\item x\n\\end{itemize}": {"heading", "list"},
        "| a | b |\n|:--|--:|\n| 1 | 2 |": {"table"},
        '{| class="x"\n|-\n| a || b\n|}': {"table"},
        "<table><tr><td>a<td>b</table>": {"table"},
        "text\n\n```\n# no heading\n- no list\n```": {"code"},
        "<pre>\n&lt;h2&gt;x&lt;/h2&gt;\n</pre>": {"code"},
        "text\n\n    for x in y:\n    - item\n\ntext": {"code"},
        "so $x_1 = 2$ holds": {"formula"},
        "<math><mi>x</mi></math>": {"formula"},
        "\\[ a^2 \\]": {"formula"},
        "a **b** c": {"other"},
        "a `b` c": {"other"},
        "see [x](http://a.b/c)": {"other"},
        "&lt;i&gt;x&lt;/i&gt;": {"other"},
        "he '''said''' [[so|that]] {{note|x}}": {"other"},
        '{"event": "note", "body": "<p>x</p>"}': {"other"},
        "> quoted": {"other"},
    }
    for text, want in cases.items():
        assert parsed(text)[0] == want, text


def test_no_markup():
    for text in ("", "Plain text.", "from $58 to $55 per run", "a < b and c > 5, x <= 3", "snake_case_name and 2 * 3 * 4", "C:\\store\\new_1 and \\\\store\\probe_2", "C# and F#, see #16", "As in [5] and [sic], <3 times", "use a -> b, b => c <- a", "wrapped at vol.\n6. The rest goes on\nhere.", "With a < b and c\n> 8, it holds", "<110>2030-02-16 01:12:22 [warn] mih: bucket=1 *late*", "#include <vector>\nstd::map<std::string, float> w;", "0;chunk_1;0.5;active"):
        assert parsed(text)[0] == set(), text


def test_clean_text_keeps_structure():
    found, clean = parsed("<h2>Head</h2><ul><li>one</li><li>two</li></ul><p>a <b>bold</b> &amp; b</p>\n\n```\ncode <b>\n```")
    assert "## Head" in clean and "- one" in clean and "a bold & b" in clean and "code <b>" in clean
    assert "<ul>" not in clean and "&amp;" not in clean


def test_wrappers_align():
    a, b = repeats(["item", "item", "text"]), repeats(["item", "code"])
    _, w = merge_wrappers([(1, a), (1, b)])
    assert expression(w) in ("item+ #TEXT? code?", "item+ code? #TEXT?")
    assert expression(repeats(["a", "b", "a", "b", "a", "b"])) == "(a b)+"
    assert align(a, a)[0][3] == 2


def test_wrappers_parse_segments():
    _, w = merge_wrappers([(5, gathered(repeats(["item", "text", "item", "text", "item", "text"]))), (1, gathered(repeats(["item", "text", "table"])))])
    program = leaves(w)
    assert [t for t, _, _ in program][:2] == ["item", "text"]
    # a repeated group is bound again and again to its own nodes, what comes behind it to those behind
    bound = bind(program, ("item", "text", "item", "text", "table", "quote"))
    assert bound[:2] == bound[2:4] and program[bound[4]][0] == "table" and bound[5] == -1
    assert bind(leaves(repeats(["atx", "code", "atx", "code"])), ("atx", "code", "atx")) == [0, 1, 0]


def test_nodes_among_code_are_no_markup():
    coded = leaves(repeats(["atx", "code", "atx", "code"]))
    assert Rules({"atx": coded}).plain(("atx", "text")) == [True, False]
    assert Rules({}).plain(("atx", "code")) == [False, False]
    assert Document("# note\n\ntext", Rules({"atx": coded})).found == set()


def test_wrappers_do_not_depend_on_partitions(spark, small):
    docs = load(spark, small, "documents")
    a, b = ({tuple(r) for r in wrappers(docs.repartition(n)).collect()} for n in (1, 7))
    assert a == b and len(a) > 10


def test_tables_come_out_as_rows():
    want = "| a | b |\n| --- | --- |\n| 1 | 2 |\n\ntail"
    for text in (
        '{| class="wikitable"\n! a !! b\n|-\n| 1 || 2\n|}\n\ntail',
        "<table><tr><th>a</th>\n<th>b</th></tr><tr><td>1<td>2</table>tail",
        "\\begin{tabular}{ll}\n\\hline\na & b \\\\\n\\hline\n1 & 2\n\\end{tabular}\n\ntail",
    ):
        assert parsed(text) == ({"table"}, want), text
    assert parsed("| a | b |\n|---|---|\n| 1 | 2 |")[1] == "| a | b |\n|---|---|\n| 1 | 2 |"
    assert parsed("<h2>\n  Head\n</h2><ol><li>\n one</li></ol>next")[1] == "## Head\n\n- one\n\nnext"


def test_clean_text_is_clean(spark, small):
    docs = load(spark, small, "documents")
    once = clean_markup(docs).join(docs.select("doc_id", "source_uri"), "doc_id").where("clean_text is not null").withColumnRenamed("elements", "before")
    induced = wrappers(docs)
    twice = clean_markup(once.selectExpr("doc_id", "source_uri", "clean_text as text"), induced=induced).selectExpr("doc_id", "elements", "clean_text as again")
    for r in once.join(twice, "doc_id").collect():
        assert r["clean_text"] == r["again"] and r["elements"] == [e for e in r["before"] if e != "other"]


def test_hosts_decide_on_ambiguous_lines(spark):
    docs = [(i, f"x://code-host/{i}", "# note\nexport A=$HOME/b\nfor f in *.i; do cp; done;") for i in range(30)]
    docs += [(100, "x://code-host/1", "# drop files"), (200, "x://text-host/1", "# drop files"), (300, None, None), (301, None, ""), (302, "broken", "**x**"), (302, "broken", "**x**")]
    df = spark.createDataFrame(docs, "doc_id long, source_uri string, text string").selectExpr("*", "'clash' as elements", "'clash' as host")
    got = {}
    for r in clean_markup(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[100][0]["elements"] == [] and got[200][0]["elements"] == ["heading"]
    assert got[300][0]["elements"] is None and got[301][0]["elements"] == [] and len(got[302]) == 2
    assert {r["host"] for r in wrappers(df).collect()} == {"code-host", "text-host", ""}
    assert clean_markup(df.limit(0)).count() == 0


def test_gaps_and_enclosures():
    assert [g for g, _ in gaps("No. 3.14 is old. New")] == [3, 16]
    assert enclosed('He said "a. b" and (c. d).') == [(8, 14), (19, 25)]
    assert gaps("“Rebuild it. Then wait!” said K.") == [(24, False)]
    assert [s for _, s in gaps("ดัชนีว่าง แคชว่าง 12 รายการ")] == [True]
    assert [g for g, _ in gaps("好了吗？没有。")] == [4]
    assert [g for g, _ in gaps("Γιατί; Χθες")] == [6] and gaps("why; not") == []


def _counted(paragraphs):
    marked, words = Counter(), Counter()
    for p in paragraphs:
        marked.update(contexts(p, words))
    return [(*k, n) for k, n in marked.items()], list(word_rows(words))


def model():
    paras = ["Dr. Orsk left. The cache was full.", "The cache grew. See sec. 3 for more.", "It works, e.g. here. We saw it.", "We met Dr. Orsk. It rose to 0.5.", "See sec. 8 again. Dr. Orsk came.", "We saw it. All is here."] * 30
    return HiddenEvents(*_counted(paras))


def test_model_learns_abbreviations():
    m = model()
    text = "Dr. Orsk left. See sec. 4 again.\n\nThe cache\nwas full. We saw it"
    assert [text[a:b] for a, b in m.split(text)] == ["Dr. Orsk left.", "See sec. 4 again.", "The cache\nwas full.", "We saw it"]


def _unmarked(sentences, rng, marks, joint):
    """Paragraphs of sentences with marks, and one without, with its true boundaries."""
    paras = [joint.join(rng.choice(sentences) + marks for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    chosen = [rng.choice(sentences) for _ in range(6)]
    ends, at = [], 0
    for c in chosen[:-1]:
        at += len(c)
        ends.append(at)
        at += len(joint)
    return paras, joint.join(chosen), ends


@pytest.mark.parametrize("script", ["latin", "lower", "han", "thai"])
def test_boundaries_between_words_without_marks(script):
    rng = random.Random(7)
    if script in ("latin", "lower"):
        some = [f"{a} {b} {c}" for a in ("The cache", "A shard", "Our planner", "Every index") for b in ("grew", "was full", "met the limit") for c in ("again", "last night", "after the merge")]
        joint, marks = " ", "."
    elif script == "han":
        some = [a + b + c for a in ("缓存", "这个分片", "我们的索引") for b in ("昨天", "每次", "又") for c in ("满了", "变大了", "重建完成")]
        joint, marks = "", "。"
    else:
        some = [a + b + c for a in ("แคช", "ดัชนี", "ระบบ") for b in ("เมื่อวาน", "ทุกครั้ง") for c in ("เต็มแล้ว", "ว่างอยู่", "โตขึ้น")]
        joint, marks = " ", ""
    paras, text, ends = _unmarked(some, rng, marks, joint)
    if script == "thai":  # without spaces as well
        _, text, ends = _unmarked(some, rng, "", "")
    m = HiddenEvents(*_counted(paras))
    if script == "lower":
        text = text.lower()
    assert m.boundaries(text) == ends
    assert m.boundaries(some[0]) == [] and HiddenEvents(_counted(paras)[0]).boundaries(text) == []


def test_rare_contexts_count_with_their_shapes(spark):
    names = ["".join(rng) for rng in product("abcdefg", repeat=2)]
    texts = [f"Word{k} alpha beta{k}. Next{k[0]} gamma. Done delta{k}." for k in names]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    full, small = fit(df), fit(df, size=10)
    assert full.total == small.total == 5 * 4 * 49  # nothing is left out
    assert len(small.next) < len(full.next) and len(small.words.all) < len(full.words.all)
    assert sum(small.words.all.values()) == sum(full.words.all.values()) == 7 * 49


def test_the_model_depends_on_no_size_of_the_corpus(spark):
    names = ["".join(rng) for rng in product("abcdefg", repeat=2)]
    texts = [f"Word{k} alpha beta{k}. Next{k[0]} gamma. Done delta{k}." for k in names]
    few, many = (fit(spark.createDataFrame([(t,) for t in [*texts, *["\n\n".join(["Go on. " * 10] * 1000)] * n]], "text string").repartition(8)) for n in (1, 32))
    assert many.total > 5 * 300_000  # so many contexts that those seen once are rarer than one in 300,000
    assert ((("<n>",), "Nexta") in many.next) and set(many.events) == set(few.events) and set(many.next) == set(few.next)
    for x in ("all", "pair", "first", "first_two", "last", "last_two"):
        assert set(getattr(many.words, x)) == set(getattr(few.words, x)), x


def test_sentences_edge_rows(spark):
    df = spark.createDataFrame([(1, "A b. C d."), (1, "A b. C d."), (2, None), (3, ""), (4, " \n\n "), (5, "🙂 x"), (6, "# Head\ntext")], "doc_id long, text string").selectExpr("*", "'clash' as sentence")
    got = {}
    for r in sentences(df, model=model()).collect():
        got.setdefault(r["doc_id"], []).append((r["sent_start"], r["sent_end"], r["sentence_text"]))
    assert set(got) == {1, 5, 6} and len(got[1]) % 2 == 0 and got[5] == [(0, 3, "🙂 x")]
    assert sorted(got[6]) == [(0, 6, "# Head"), (7, 11, "text")]
    assert sentences(df.limit(0), model=model()).count() == 0


def test_offsets_round_trip(spark, small):
    docs = load(spark, small, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    ends = {}
    for r in sentences(docs, model=fit(docs)).orderBy("doc_id", "sent_start").collect():
        a, b = r["sent_start"], r["sent_end"]
        assert texts[r["doc_id"]][a:b] == r["sentence_text"] == r["sentence_text"].strip() and a >= ends.get(r["doc_id"], 0)
        ends[r["doc_id"]] = b
