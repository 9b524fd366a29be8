from __future__ import annotations

import pytest

from tickloom.llm.residue import ResidueConfig, find_residue, judge_tail, tail_of, unfilled_slots

CODE = "import os\n\n\ndef move(a, b):\n    return a.rename(b)\n"
CASES = [
    ("lib/a.py", "upstream closed the connection before any header arrived, reason: timeout\n", "error"),
    ("lib/a.css", ".a {\n  color: red;\nThe site is down for maintenance. We will be back at 16:00 UTC.\n", "error"),
    ("lib/a.rs", "<html>\n<head><title>502 Bad Gateway</title></head>\n<body>\n<center><h1>502 Bad Gateway</h1></center>\n<hr><center>gated/1.2</center>\n</body>\n</html>\n", "error"),
    ("lib/a.rs", '{"message": "Gone", "status": 410, "documentation": "https://a.invalid/help"}\n', "error"),
    ("docs/a.md", "# a\n\nLa página solicitada no existe.\n\na.invalid 19f2e04b-12\n", "error"),
    ("lib/a.go", "<html><head><title>x</title></head><body>You need to turn on scripts to see this file.</body></html>", "script"),
    ("lib/a.go", "Please turn on JavaScript in your browser and reload the page.\r\n", "script"),
    ("lib/a.go", "﻿Diese Seite benötigt JavaScript. Bitte aktivieren Sie es.", "script"),
    ("docs/a.txt", "a.txt\n-----\n..............\nxxxxxxxxxxxxxxxxx\n", "filler"),
    ("lib/a.js", "// a.js\n\n// Lorem ipsum nisi do laboris aliquip amet quis minim.\n", "filler"),
    ("lib/a.js", CODE + "blah blah blah blah blah blah blah blah blah blah", "filler"),
    ("docs/a.md", "# a\n\nThis section will be written later.\n", "filler"),
    ("LICENSE", "MIT License\n\nCopyright (c) [YEAR] <your-owner>\n\nPermission is granted.", "placeholder"),
    ("lib/a.py", "# Maintained by YOUR_MAINTAINER_HERE, report to ((email))\n" + CODE, "placeholder"),
    ("lib/a.js", "const NAME = '%%SERVICE_NAME%%';\n" + "f(1);\n", "placeholder"),
]
SOUND = [
    ("lib/a.py", CODE),
    ("docs/trouble.md", "# Known problems\n\nIf the service answers 503 Service Unavailable, wait.\n\nA page saying that you need to enable JavaScript comes from the proxy.\n\n## More\n\nThe pool keeps each handle.\n"),
    ("docs/scaffold.md", "Write `{{ scaffold.project_name }}` where the name goes; `YOUR_NAME_HERE` is replaced.\n\n```\n{{ scaffold.author }}\n```\n\nDone by hand.\n"),
    ("templates/LICENSE", "Copyright (c) {{ year }} {{ owner }}\n"),
    ("web/page.vue", "<template>\n<div>{{ author }}</div>\n</template>\n"),
    ("lib/messages.js", "module.exports = {\n  404: 'Not Found',\n  js: 'Please enable JavaScript to continue',\n};\n"),
    ("tests/test_wrap.py", "def test():\n    text = '''Lorem ipsum dolor sit amet'''\n    assert wrap(text)[0].startswith('Lorem')\n"),
    ("lib/a.ts", "export const greet = (author) => `by ${author}, ${year}`;\n"),
    ("lib/a.sh", '#!/bin/sh\nOWNER="${owner}"\necho "$OWNER"\n'),
    ("lib/a.c", '#ifndef __VERSION__\n#define __VERSION__ 3\n#endif\nint f(void) { return 1; }\n'),
    ("docs/a.html", "<html><body>\n<noscript>Some charts need JavaScript; the tables below work without it.</noscript>\n<p>All of the tables are here.</p>\n</body></html>\n"),
    ("lib/a.py", CODE + "# TODO: split the pool and add a test\n"),
    ("lib/a.html", '<input name="a" placeholder="Your name here">\n<p>Save the form before you leave.</p>\n'),
]


def verdict(path, text):
    kind, _ = judge_tail(tail_of(text))
    return kind or ("placeholder" if unfilled_slots(text, path) else None)


@pytest.mark.parametrize("path,text,kind", CASES)
def test_cases(path, text, kind):
    assert verdict(path, text) == kind


@pytest.mark.parametrize("path,text", SOUND)
def test_sound_files(path, text):
    assert verdict(path, text) is None


def test_operator(spark):
    rows = [(i, f"o/r{i}", p, t, "x") for i, (p, t, _) in enumerate(CASES)]
    rows += [(100 + i, f"o/s{i}", p, t, "x") for i, (p, t) in enumerate(SOUND)]
    rows += [(200, None, None, None, None), (201, None, None, "", None), (202, "o/long", "lib/long.py", CODE * 20_000, None)]
    rows += [(203, "o/long", "lib/long2.py", CODE * 20_000 + "fetch gave up after 3 tries", None), (0, "o/r0", CASES[0][0], CASES[0][1], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, repo string, path string, text string, kind string")
    got = sorted((r.doc_id, r.kind) for r in find_residue(docs).collect())
    assert got == sorted([(i, k) for i, (_, _, k) in enumerate(CASES)] + [(0, CASES[0][2]), (203, "error")])
    assert find_residue(docs.limit(0)).count() == 0


def test_statements_however_deep_or_long(spark):
    deep = CODE + "The site is down for maintenance.\n" + "</div>\n" * 20 + "<hr>\n" * 20 + "</body>\n</html>\n"
    style = "<style>" + "a { b: c; } " * 3_000 + "</style>"
    page = f"<html><head>{style}</head><body><p>You need to turn on scripts to see this file.</p>{style}</body></html>"
    plain_long = "Please turn on JavaScript in your browser and reload. " + "z9 " * 10_000
    sound = f"<html><body><noscript>You need to turn on scripts to see all charts.</noscript>{'<p>All of the tables stand below and work without it</p>' * 500}</body></html>"
    assert [verdict("lib/a.go", x) for x in (deep, page, plain_long, sound, "fg(h, " * 200_000)] == ["error", "script", "script", None, None]
    head = "\n" * 5_000 + "zz " * 200 + "remarkable\n" + CODE
    long = CODE + " ".join(f"term{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)) + "\n"
    docs = spark.createDataFrame([(1, "o/a", "lib/remarkable.py", head + "Error: fetch of it\nfetch gave up after 3 tries"), (2, "o/b", "lib/other.py", long + deep)], "doc_id long, repo string, path string, text string")
    assert {(r.doc_id, r.kind, r.mismatch) for r in find_residue(docs).collect()} == {(1, "error", False), (2, "error", True)}


@pytest.mark.parametrize("fill", [0, 150, 250, 2_000])
def test_pages_on_one_line_whatever_its_length(spark, fill):
    words = [f"term{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    prose = "".join(f"<p>All of the {w} stand below</p>" for w in words)
    quiet = "<b class='zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz'></b>" * fill  # 90 characters each: 150 and 250 of them lie on either side of 20,000
    style = "<style>" + "a { b: c; } " * fill * 8 + "</style>"
    need = "You need to turn on scripts to see all charts."
    sorry = "<h2>Sorry, we can't find that page</h2><p>It may have been moved. Go back to the <a href='/'>start page</a>.</p>"
    texts = {
        1: (f"<html>{quiet}<div>{sorry}</div></html>", "error"),  # words after the statement
        2: (f"<html><div>{sorry}</div>{quiet}</html>", "error"),
        3: (f"<html>{style}<p>Please <b>turn on</b> scripts to go on.</p></html>", "script"),  # a statement with tags inside
        4: (f"<html><!-- dummy file, only here so that the folder exists -->{quiet}</html>", "filler"),
        5: (f"<html>{quiet}{prose}<p>{need}</p></html>", "script"),  # in place of the remainder of a long text
        6: (f"<html>{quiet}<noscript>{need}</noscript></html>", "script"),
        7: (f"<html><noscript>{need}</noscript>{quiet}<p>All of the tables stand below and work without it</p></html>", None),
        8: (f"<html>{quiet}{prose}</html>", None),
        9: (f'{{"message": "<b>Gone</b>", "note": "{quiet}", "status": 410, "code": 410}}', "error"),
    }
    docs = [(i, f"o/r{i}", "lib/a.go", t) for i, (t, _) in texts.items()]
    # unknown responses, alone on a line and at the end of a page on one line
    docs += [(20 + i, f"o/s{i}", f"lib/f{i}.go", f"<html>{quiet}<p>Wir machen eben Pause</p><p>Wir sind gleich wieder bei Ihnen</p></html>") for i in range(4)]
    docs += [(30 + i, f"o/t{i}", f"lib/g{i}.go", f"<html>{quiet}<p>own{'abcd'[i] * 3}</p>{prose}<p>Bitte warten Sie noch einen Moment</p></html>") for i in range(4)]
    got = {r.doc_id: r.kind for r in find_residue(spark.createDataFrame(docs, "doc_id long, repo string, path string, text string")).collect()}
    assert got == {i: k for i, (_, k) in texts.items() if k} | {k + i: "duplicate" for i in range(4) for k in (20, 30)}


def test_blanks_between_tags_take_linear_time():
    assert verdict("lib/a.go", "<a> " * 10_000 + "Page not found") == "error"
    assert verdict("lib/a.go", "<a> " * 10_000 + "All of the tables") is None


def test_unknown_responses_found_by_all_of_their_text(spark):
    page = "<html>\n<body>\n<h1>Wir machen eben Pause</h1>\n<p>Wir sind gleich wieder bei Ihnen</p>\n</body>\n</html>\n"
    rows = [(i, f"o/r{i}", f"lib/f{i}.py", CODE + page) for i in range(4)]
    ends = "Wir machen eben eine kleine Pause\n\nBitte warten Sie noch einen Moment\n\nFrontdoor 17\n"
    rows += [(10 + i, f"o/s{i}", f"lib/g{i}.py", ends) for i in range(4)]
    rows += [(20 + i, f"o/t{i}", f"lib/h{i}.py", f"{ends} {CODE} def own{'abcd'[i] * 3}(): pass\n") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, repo string, path string, text string")
    assert {(r.doc_id, r.kind, r.hosts) for r in find_residue(docs).collect()} == {(i + k, "duplicate", 4) for i in range(4) for k in (0, 10)}


def test_unknown_response_found_by_its_spread(spark):
    said = "Wir sind gleich wieder bei Ihnen"
    rows = [(i, f"o/r{i}", f"lib/f{i}.py", said) for i in range(4)]
    rows += [(10 + i, f"o/v{i}", "vendor/same.py", "the very same vendored words") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, repo string, path string, text string")
    assert {(r.doc_id, r.kind, r.hosts) for r in find_residue(docs).collect()} == {(i, "duplicate", 4) for i in range(4)}


def test_paraphrases_are_found_by_the_evidence_of_many_hosts(spark):
    said = [
        "We are unable to locate the document you were looking for.",
        "Backend responded with an unexpected status; please retry later.",
        "A scripting-capable user agent is compulsory to view this.",
    ]
    rows = [(10 * k + i, f"o/r{i}", f"lib/f{k}{i}.py", (CODE if i % 2 else "") + x + "\n") for k, x in enumerate(said) for i in range(4)]
    # worded once, but of words known from the ones above; and prose of the file's own
    rows += [(100, "o/x", "lib/x.go", "We are unable to locate the wallet you were looking for.\n")]
    rows += [(101, "o/y", "docs/locate.md", "# Locate\n\nThe document store keeps each wallet you were given, unable to move.\n")]
    docs = spark.createDataFrame(rows, "doc_id long, repo string, path string, text string")
    for cfg in (ResidueConfig(), ResidueConfig(statements=False)):
        got = {r.doc_id: r.kind for r in find_residue(docs, cfg).collect()}
        assert got == {r[0]: "duplicate" for r in rows[:-1]}


def test_error_page_with_a_menu(spark):
    menu = "".join(f"<li><a href='/{x}'>{x.title()} pages here</a></li>\n" for x in ("home", "news", "about", "contact", "help") * 4)
    page = f"<html><head><title>404 Not Found</title></head>\n<body><h1>Page not found</h1>\n<ul>{menu}</ul></body></html>\n"
    rows = [(1, "o/a", "lib/a.py", page), (2, "o/b", "errors/404.html", page.replace("Page not found", "Lost"))]
    docs = spark.createDataFrame(rows, "doc_id long, repo string, path string, text string")
    assert [(r.doc_id, r.kind) for r in find_residue(docs).collect()] == [(1, "error")]


def test_hot_response_and_extra_columns(spark):
    rows = [(i, f"o/r{i % 50}", f"lib/f{i % 40}.py", "The gate is shut today, come back soon.\n", "x", 1.0) for i in range(400)]
    rows += [(1000 + i, None, None, None, None, None) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, repo string, path string, text string, skeleton string, shared double")
    assert {(r.kind, r.hosts) for r in find_residue(docs, ResidueConfig(statements=False)).collect()} == {("duplicate", 50)}
