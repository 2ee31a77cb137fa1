from packwright.functions.ccode import functions, parse_detached

CODE = """#include <x.h>
/* void no(void) { } */
static int
foo(struct s *p, int n)
{
    int i = init(n);
    if (a) { f(); } else if (b) { g(h(1)); }
    for (i = 0; i < n; i++)
        work(i);
    do { step(); } while (more());
    switch (n) { case 1: one(); break; default: two(); }
    p->cb(n);
    x = y * z;
    while (n--) if (strcmp(a, "}{") == 0) return bar(n);
lab:
    goto lab;
}
namespace q { void A::m(int k) const { T<int> v(k); u = f2(k); } }
extern "C" { int ext(void) { return 0; } }
class Z { public: int in() { return k(); } };
int arr[] = { 1, 2 };
struct S { int a; };
"""


def test_functions_and_lines():
    assert [(f.name, f.line) for f in functions(CODE)] == [("foo", 4), ("m", 18), ("ext", 19), ("in", 20)]
    assert CODE[functions(CODE)[0].start :].startswith("static int\nfoo(")


def test_calls_and_conditions():
    calls = {c.name: c.conditions for c in functions(CODE)[0].walk.calls}
    assert calls == {
        "init": [], "f": ["a"], "g": ["!(a)", "b"], "h": ["!(a)", "b"], "work": ["i < n"], "step": ["more()"], "more": [], "one": ["n"], "two": ["n"],
        "strcmp": ["n--"], "bar": ["n--", 'strcmp(a, "}{") == 0'],
    }
    assert [c.name for c in functions(CODE)[0].walk.calls][2:4] == ["g", "h"]


def test_conditions_of_their_own_condition():
    assert parse_detached("int t() { if (f(x)) {} }").calls[0].conditions == []


def test_bare_for_condition_loses_its_outer_characters():
    assert parse_detached("void t() { for (; (a) && (b);) f(); }").calls[0].conditions == ["a) && (b"]


def test_rows():
    assert sorted(functions(CODE)[0].walk.keep_lines) == [3, 4, 5, 6, 7, 8, 9, 11, 12, 13]


def test_nothing():
    assert functions("") == [] and functions("int x;") == [] and parse_detached("garbage (((").calls == []
    assert functions("int f( { {") == []


def test_deep_nesting_and_length():
    body = "int f() {" + "if (a) {" * 200 + "g();" + "}" * 200 + "}"
    assert len(functions(body)[0].walk.calls[0].conditions) == 200
    assert len(functions("int f() {" + "g();" * 5000 + "}")[0].walk.calls) == 5000


def test_generated_code_nests_without_a_limit():
    chain = "int f() { if (a0) { g(); } " + " ".join(f"else if (a{i}) {{ g(); }}" for i in range(1, 3000)) + " }"
    calls = functions(chain)[0].walk.calls
    assert len(calls) == 3000 and len(calls[-1].conditions) == 3000
    deep = "int f() {" + "{" * 10_000 + "g();" + "}" * 10_000 + "}"
    assert [c.name for c in functions(deep)[0].walk.calls] == ["g"]
    ladder = "int f() { " + " ".join(f"if (a{i}) {{ }} else" for i in range(10_000)) + " g(); }"
    assert len(functions(ladder)[0].walk.calls[0].conditions) == 10_000


OLD = """static char *
join(a, b, n)
    char *a, *b;
    register int n;
{
    return copy(a, b, n);
}
int declared(a, b);
extern int next(void) MACRO;
struct point origin;
int modern(int a) { return old(a); }
main(argc, argv) char **argv; { run(argv); }
"""


def test_old_parameter_lists():
    found = functions(OLD, cpp=False)
    assert [(f.name, f.line) for f in found] == [("join", 2), ("modern", 11), ("main", 12)]
    assert OLD[found[0].start : found[0].end].startswith("static char *\njoin(a, b, n)") and OLD[found[0].end - 1] == "}"
    assert found[0].walk.identifiers == {"join", "a", "b", "n", "copy"} and sorted(found[0].walk.keep_lines) == [5]
    assert [c.name for f in found for c in f.walk.calls] == ["copy", "old", "run"]
    assert functions("int f(a) int a; int g; { h(); }") == []


def test_branches_that_open_the_same_brace():
    code = "#ifdef WIDE\nint f(long a) {\n#else\nint f(int a) {\n#endif\n  g(a);\n}\nint k() {\n#if X\n  one();\n#elif Y\n  two();\n#endif\n}\n"
    assert [(f.name, f.line) for f in functions(code)] == [("f", 2), ("k", 8)]
    assert [c.name for c in functions(code)[1].walk.calls] == ["one"]
    both = "int k() {\n#if X\n  one();\n#else\n  two();\n#endif\n}\n"
    assert [c.name for c in functions(both)[0].walk.calls] == ["one", "two"]


def test_words_of_the_other_language():
    code = "int f(struct s *this) { int new = this->class; delete(new); try(new); return new; }"
    c = functions(code, cpp=False)[0].walk
    assert c.identifiers == {"f", "s", "this", "new", "class", "delete", "try"}
    assert [x.name for x in c.calls] == ["delete", "try"]
    assert parse_detached(code) == c
    cpp = "int f() { T *p = new T(g()); ns::h(p); delete p; try { k(); } catch (E &e) { m(); } }"
    walk = parse_detached(cpp, "a.c")
    assert walk == functions(cpp)[0].walk and [x.name for x in walk.calls] == ["g", "k", "m"]
    plain = "int f(int a) { return g(a); }"
    assert parse_detached(plain, "a.cc") == parse_detached(plain, "a.c") == functions(plain)[0].walk
    broken = "int f(int a) { return g(a); } }"
    assert [x.name for x in parse_detached(broken).calls] == ["g"]
