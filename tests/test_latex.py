import pytest

from quillbank.functions import latex


def kinds(nodes):
    return [n[0] for n in nodes]


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (r"\frac{1}{2}", "frac"), (r"\dfrac12", "frac"), ("x^2", "sup"), ("x_1", "sub"), ("x_1^2", "subsup"), (r"\sqrt{3}", "rad"), (r"\sqrt[3]{x}", "rad"),
        (r"\sum_{n=1}^{k} n", "nary"), (r"\int_0^1 x", "nary"), (r"\lim_{x \to 0}", "lim"),
    ],
)
def test_structure(text, kind):
    assert kinds(latex.parse(text))[0] == kind


def test_details():
    assert latex.parse(r"\vec{a}") == [("run", "a⃗")]
    assert latex.parse(r"\foo") == [("run", "foo")]
    assert latex.parse(r"\alpha\leq\sin") == [("run", "α"), ("run", "≤"), ("run", "sin")]
    assert latex.parse(r"\left(x\right)") == [("run", "("), ("run", "x"), ("run", ")")]
    # What older behaviour lost after these is kept.
    assert latex.parse(r"\left.x\right|y") == [("run", "x"), ("run", "|"), ("run", "y")]
    assert latex.parse(r"\left\langle x") == [("run", "⟨"), ("run", " "), ("run", "x")]
    assert latex.parse("a}b") == [("run", "a"), ("run", "b")]
    assert "m:nary" in latex.omml(latex.parse(r"\sum_{n=1}^{k} n")) and "∑" in latex.omml(latex.parse(r"\sum n"))
    assert "<m:deg><m:r>" in latex.omml(latex.parse(r"\sqrt[3]{x}")) and "degHide" in latex.omml(latex.parse(r"\sqrt{x}"))


@pytest.mark.parametrize("text", ["{", "}", "\\", "^", "_", r"\frac", r"\sqrt[", r"\sum_", "$", "$$", "$a", "a^", "😀\x07", r"\left", r"\vec", "x^{", "\\(a", "中^2"])
def test_never_fails(text):
    latex.components(text)
    latex.omml(latex.parse(text))


def test_mixed():
    assert [c[0] for c in latex.components("求 x^2 的值")] == ["text", "math", "text"]
    assert [c[1] for c in latex.components("求 x^2 的值")][::2] == ["求 ", " 的值"]
    assert [c[0] for c in latex.components("a $x$ b\n$$y$$ \\(z\\)")] == ["text", "math", "text", "break", "math", "text", "math"]
    assert latex.components("純文字") == [("text", "純文字", None)]
    assert latex.components("") == latex.components(None) == []
    assert [c[0] for c in latex.components(r"角度 \theta 中 \frac{1}{2}")] == ["text", "math", "text", "math"]


def test_in_spark(spark):
    df = spark.createDataFrame([(1, "x^2"), (2, None), (3, "x^2")], "id int, t string")
    got = {r.id: r for r in df.select("id", latex.parse_latex("t").alias("m"), latex.render("t").alias("c"), latex.converts("t").alias("ok")).collect()}
    assert got[1].m == got[3].m and "m:sSup" in got[1].m and got[2].m is None
    assert [p.kind for p in got[1].c] == ["math"] and got[2].c == [] and got[1].ok
    latex.register(spark)
    rows = spark.sql("SELECT * FROM tokenize('\\\\frac{1}^x')").orderBy("pos").collect()
    assert [r.type for r in rows] == ["command", "lbrace", "char", "rbrace", "sup", "char"]


def test_escapes():
    assert latex.tokens(r"\, \{ \\") == [("space", " "), ("space", " "), ("char", "{"), ("space", " "), ("char", "\\")]
