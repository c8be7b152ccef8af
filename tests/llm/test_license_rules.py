"""Each license rule on a minimal text of its own, and the keyword gate against a scan without it."""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

import pytest

from gridloom.llm import licenses


def shortest(parsed) -> str:
    """A shortest match of a parsed pattern, the first alternative of each."""
    out = ""
    for op, arg in parsed:
        if op is C.LITERAL:
            out += chr(arg)
        elif op is C.IN:
            kind, x = arg[0]
            out += chr(x) if kind is C.LITERAL else chr(x[0]) if kind is C.RANGE else "1"
        elif op is C.MAX_REPEAT:
            out += shortest(arg[2]) * arg[0]
        elif op is C.SUBPATTERN:
            out += shortest(arg[3])
        elif op is C.BRANCH:
            out += shortest(arg[1][0])
        else:
            raise ValueError(op)
    return out


RULES = [r for r in licenses.rules() if r.priority]
TEXTS = [shortest(_parser.parse(r.pattern)) for r in RULES]


def test_every_rule_passes_its_gate_on_its_shortest_text():
    for r, text in zip(RULES, TEXTS, strict=True):
        assert re.fullmatch(r.pattern, text), r
        assert r.keyword in text, (r, text)


def test_gated_scan_equals_a_scan_of_all_rules():
    find = licenses.scanner()
    compiled = [(re.compile(rf"(?<![^ ]){r.pattern}(?![^ ])"), r) for r in RULES]
    for text in TEXTS:
        starts = [0, *(m.end() for m in re.finditer(" ", text))]
        at = lambda c: sum(s <= c for s in starts) - 1
        hits = [(at(m.start()), at(m.end() - 1) + 1, r.label, r.priority) for p, r in compiled for m in p.finditer(text)]
        assert hits and sorted(find(text)[2]) == sorted(licenses.uncontained(hits)), text


@pytest.mark.parametrize("text, label", [
    ("AGPL v3", "agpl-3.0"), ("gnu agplv3", "agpl-3.0"), ("licensed under the AGPL", "agpl"), ("MPL 1.1", "mpl-1.1"), ("OSL 3.0", "osl-3.0"), ("MS-PL", "ms-pl"), ("SSPL v1", "sspl-1.0"),
    ("zero clause BSD", "bsd-0-clause"), ("CreativeML Open RAIL-M", "openrail-m"), ("Q Public License", "qpl-1.0"), ("licensed under the OFL", "ofl-1.1"), ("no part of this work may be reproduced", "proprietary"),
])
def test_texts_without_the_keyword_of_the_line(text, label):
    assert label in {h[2] for h in licenses.scanner()(text)[2]}
