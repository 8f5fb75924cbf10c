"""The lexer with modes, on its own."""

import ast
import random
import time
import tracemalloc

import pytest

from palisade.functions import lexer

WANTED = {"python": ["OpenAI", "Anthropic", "client"], "typescript": ["OpenAI", "Anthropic"]}


def found(text, grammar):
    return [(text[c[1] : c[3]], c[4], c[5]) for c in lexer.calls(text, grammar, WANTED)]


@pytest.mark.parametrize(
    ("text", "calls"),
    [
        ("(client\n .OpenAI())", ["client\n .OpenAI()"]),
        ("{}.OpenAI(); [1][0] . OpenAI(k)", ["{}.OpenAI()", "[1][0] . OpenAI(k)"]),
        ('"a".OpenAI(); f"{OpenAI()}"', ['"a".OpenAI()', "OpenAI()"]),
        ("class  OpenAI(X):\n def  OpenAI(self): pass", []),
        ('f"{{OpenAI()}} {x:{OpenAI(k)}>3} {a!r} {d["k"]}" + OpenAI()', ["OpenAI(k)", "OpenAI()"]),
        ("rf'''{OpenAI('''a''')}\n''' # OpenAI()", ["OpenAI('''a''')"]),
        ('"open OpenAI()\nOpenAI()', ["OpenAI()"]),
        ("'''OpenAI()\n", []),
        ("OpenAI\n()\nx = \\\n  OpenAI()", ["OpenAI()"]),
        ("a = OpenAI((1)\nb = OpenAI()", ["OpenAI()"]),
        ("] } ) OpenAI()", ["OpenAI()"]),
        ("return (client).OpenAI()", ["(client).OpenAI()"]),
        ("await é.OpenAI(u=f'{Anthropic(k)}')", ["é.OpenAI(u=f'{Anthropic(k)}')", "Anthropic(k)"]),
    ],
)
def test_python(text, calls):
    assert [c[0] for c in found(text, "python")] == calls


@pytest.mark.parametrize(
    ("text", "calls"),
    [
        ("new OpenAI<T>({})", ["new OpenAI<T>({})"]),
        ("new OpenAI<A<B>, (x: C) => D>(x)", ["new OpenAI<A<B>, (x: C) => D>(x)"]),
        ("`${new OpenAI({})} new OpenAI()`", ["new OpenAI({})"]),
        ("`a${`b${new OpenAI()}`}\\`new OpenAI()`", ["new OpenAI()"]),
        ('x = /"/; y = /[/"]/g; new OpenAI()', ["new OpenAI()"]),
        ("a / b / new OpenAI(1 / 2)", ["new OpenAI(1 / 2)"]),
        ("<div>new OpenAI() isn't {new OpenAI(1)} <b x='new OpenAI()' y={new OpenAI(2)}/></div>; new OpenAI(3)", ["new OpenAI(1)", "new OpenAI(2)", "new OpenAI(3)"]),
        ("return <>don't</>; new OpenAI()", ["new OpenAI()"]),
        ("const f = <T,>(x: T) => x < 1; a < b; new OpenAI()", ["new OpenAI()"]),
        ("new openai.OpenAI(); new OpenAI; new /* a */ OpenAI /* b */ (k); x.new; renew OpenAI()", ["new /* a */ OpenAI /* b */ (k)"]),
        ("// new OpenAI()\n/* new OpenAI() */ 'new OpenAI()' + \"new OpenAI()\"", []),
    ],
)
def test_script(text, calls):
    assert [c[0] for c in found(text, "tsx")] == calls


def test_arguments_and_objects():
    text = "OpenAI(# c\n a, k=f(1, 2), *b, **c, s = r'x', t='a' 'b', )"
    head, start, args, end, line, column, last, _, _, _, table = lexer.calls(text, "python", WANTED)[0]
    assert [(n, text[a:b], kind) for n, a, b, kind in table] == [(None, "a", "name"), ("k", "k=f(1, 2)", "other"), (None, "*b", "splat"), (None, "**c", "splat"), ("s", "s = r'x'", "string"), ("t", "t='a' 'b'", "other")]
    assert text[:last].endswith("'b'") and (line, column) == (1, 1)
    text = "new OpenAI(f({}), { a: { b }, ...c, /* d */ }, {e})"
    call = lexer.calls(text, "typescript", WANTED)[0]
    assert text[call[7] : call[8]] == "{ a: { b }, ...c, /* d */ }" and text[: call[9]].endswith("...c")


def test_any_depth_in_linear_time():
    texts = [("OpenAI(" + "(" * n + ")" * n + ")\n") + "# said\n" * n for n in (20_000, 80_000)]
    took = []
    for t in texts:
        began = time.perf_counter()
        assert len(lexer.calls(t, "python", WANTED)) == 1
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5
    for opening, closing in (("`${", "}`"), ("<a>{", "}</a>"), ("{a: ", "}")):
        assert len(lexer.calls("x = " + opening * 3000 + "new OpenAI()" + closing * 3000, "tsx", WANTED)) == 1


@pytest.mark.parametrize(("text", "grammar"), [("# é\n" * 200_000 + "f(OpenAI())\n", "python"), ("x = [" + "1, " * 100_000 + "OpenAI(a, k=1)]\n", "python"), ("x = [" + "{ a: 1 }, " * 50_000 + "new OpenAI({ a, b: 1 }, c)]\n", "tsx")])
def test_what_a_long_file_takes(text, grammar):
    tracemalloc.start()
    call = lexer.calls(text, grammar, WANTED)[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    before = text[: call[1]]
    assert call[4] == before.count("\n") + 1 and call[5] == len(before.split("\n")[-1].encode()) + 1
    assert len(call[10]) == (0 if "f(" in text else 2) and most < 2.5 * len(text.encode())


def test_a_long_line_of_calls_in_linear_time():
    took = []
    for n in (5_000, 40_000):
        text = "é = OpenAI(); " * n
        began = time.process_time()
        assert [c[4:6] for c in lexer.calls(text, "python", WANTED)] == [(1, 15 * i + 6) for i in range(n)]
        took.append(time.process_time() - began)
    assert took[1] < 16 * took[0] + 0.2


@pytest.mark.parametrize("seed", range(5))
def test_python_as_its_own_parser(seed):
    """Random expressions: calls, places and argument counts as in the syntax tree."""
    rng = random.Random(seed)

    def made(depth):
        kind = rng.randrange(9) if depth else rng.randrange(2)
        inner = lambda: made(depth - 1)
        return [lambda: rng.choice(["x", "é1", "12", "0x1f", "1.5e-3"]), lambda: rng.choice(["'a'", '"(#"', "'''\n)'''", "rb'\\''", "f'{{'"]), lambda: f"OpenAI({inner()}, k={inner()})", lambda: f"({inner()}).OpenAI()", lambda: f"[{inner()}, {inner()}][0]", lambda: f"{{{inner()}: {inner()}}}", lambda: f'f"""{{({inner()})!r:>{{({inner()})}}}} t"""', lambda: f"a . b(*{inner()}).OpenAI(\n{inner()} # )\n)", lambda: f"({inner()} + {inner()})"][kind]()

    for _ in range(150):
        text = f"v = ({made(4)})\n"
        try:
            tree = ast.parse(text)
        except SyntaxError:
            continue
        want = sorted((ast.get_source_segment(text, n), n.lineno, n.col_offset + 1, len(n.args) + len(n.keywords)) for n in ast.walk(tree) if isinstance(n, ast.Call) and getattr(n.func, "attr", getattr(n.func, "id", "")) in ("OpenAI",))
        got = sorted((text[c[1] : c[3]], c[4], c[5], len(c[10])) for c in lexer.calls(text, "python", WANTED))
        assert got == want, text


def test_any_text_is_read_to_its_end():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["'", '"', "`", "${", "{", "}", "(", ")", "<", ">", "/", "\\", "\n", "f'", "new OpenAI", " ", "a", ".", "</", "/*", ":", "=", ","]) for _ in range(rng.randrange(40)))
        for grammar in ("python", "typescript", "tsx"):
            for c in lexer.calls(text, grammar, WANTED):
                assert 0 <= c[1] <= c[2] < c[3] <= len(text) and text[c[2]] == "(" and text[c[3] - 1] == ")"
    assert lexer.calls(None, "python", WANTED) == [] and lexer.calls("OpenAI()", None, WANTED) == []
