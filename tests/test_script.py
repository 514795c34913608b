"""Shorter scripts."""

from __future__ import annotations

import pytest

from pagemill.functions.script import JSMinify, ScriptError, minify_js, tokens_of

PLAIN = JSMinify(mangle=False, fold=False)


@pytest.mark.parametrize(
    ("script", "wanted"),
    [
        ("var a = 1 ; // c\nvar b = 2;", "var a=1;var b=2"), ("a = b\nc = d", "a=b\nc=d"), ("a = b\n+ c", "a=b+c"), ("return\nx", "return\nx"), ("a\n++b", "a\n++b"), ("a + ++b - -c", "a+ ++b- -c"), ("x = a / b / /re[/]g/i.test(s)", "x=a/b/ /re[/]g/i.test(s)"), ("if (a) { b(); } else { c() }", "if(a){b()}else{c()}"),
        ("f(function () {\n return 1 ;\n})", "f(function(){return 1})"), ("s = 'a  b' + \"c // d\"", "s='a  b'+\"c // d\""), ("t = `x  ${ a + `y ${b}` }  z`", "t=`x  ${ a + `y ${b}` }  z`"), ("/*! keep */\n/* drop */ a", "/*! keep */\na"), ("1 .toString()", "1 .toString()"), ("while (x) ;", "while(x);"), ("{ while (x) ; }", "{while(x);}"),
        ("a = {}\nb", "a={}\nb"), ("x = y\n(z)", "x=y(z)"), ("", ""), ("typeof x in y", "typeof x in y"), ("for (;;) { }", "for(;;){}"),
    ],
)
def test_blanks(script, wanted):
    assert minify_js(script, PLAIN) == wanted


def test_constants():
    assert minify_js("a = true; b = {true: false, x: !false}; c = 0.50 + 1000 + 0x10 + 1_000; d = 'a' + 'b'; o.true", JSMinify(mangle=False)) == "a=!0;b={true:!1,x:!!1};c=.5+1e3+0x10+1e3;d='ab';o.true"
    assert minify_js("f(a + 'b' + 'c')", JSMinify(mangle=False)) == "f(a+'b'+'c')"


def test_names():
    script = "function area(width, height) { var result = width * height, factor = o.width; return function (inner) { return inner + result * factor; }; } area(1, 2);"
    assert minify_js(script) == "function area(d,b){var c=d*b,a=o.width;return function(e){return e+c*a}}area(1,2)"
    for kept in ("function f(long) { return {long}; }", "function f(long) { return {long: 1}; }", "function f(long) { return `${long}`; }", "function f(long) { eval('long'); }", "function f({long}) { return long; }"):
        assert "long" in minify_js(kept)
    assert minify_js("var outer = 1; use(outer)") == "var outer=1;use(outer)"


def test_errors_and_tokens():
    for bad in ("a = 'x", "a = `x", "/* x", "x = /re"):
        with pytest.raises(ScriptError):
            minify_js(bad)
    assert [t.kind for t in tokens_of("#!/bin/x\na?.b ?? /r/g.c")] == ["name", "sign", "name", "sign", "regex", "sign", "name"]


@pytest.mark.parametrize("script", ["function f(aa,bb){if(aa)\nreturn bb\nelse\nreturn aa+1}", "var x=function(yy){for(var ii=0;ii<yy.length;ii++){g(yy[ii])}};x([1])", "a=b?c:d,e=[1,2,],g=(h,i)=>h+i"])
def test_again_changes_nothing(script):
    once = minify_js(script)
    assert minify_js(once) == once and len(once) <= len(script)


def test_minified_pages():
    from pagemill.functions.markup import Minify, minify
    from pagemill.functions.styles import minify_css_inline
    from pagemill.sources.tree import parse

    page = parse("<style> p { color : red } </style><script> var a = 1 ; </script><script type=x> {{ }} </script><p title='a b' id='c'> x  y <!-- c --></p><p>z</p>")
    assert minify(page, Minify(minify_css=True, minify_js=True)) == "<html><head><style>p{color:red}</style><script>var a=1</script><script type=x> {{ }} </script></head><body><p title=\"a b\" id=c> x y <p>z</p></body></html>"
    whole = minify(page, Minify(False, False, False, False))
    assert '<p title="a b" id="c"> x  y <!-- c --></p><p>z</p>' in whole
    assert minify_css_inline(" color : #ffffff ; margin : 0.5em ") == "color:#fff;margin:.5em"
