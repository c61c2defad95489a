"""License scan by ordered signature rules.

Each rule is a regex with a label, a priority and the keywords without one of which it can't match.
Both are looked for in the text with each run of white space, and the comment marks at the line ends in it,
folded to one space, so that wrapped notices are found. One automaton looks for all keywords, and texts
without any are done then. Of detections, one that lies within
another of the same or a higher priority is suppressed, so "gpl-3.0" leaves no plain "gpl" beside
it; base phrases are found by words, and their labels always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textbuf
from quire.llm.license_rules import WRITTEN

#: Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
WORD_SEPARATOR = np.ones(256, bool)
WORD_SEPARATOR[0x30:0x3A] = WORD_SEPARATOR[0x61:0x7B] = WORD_SEPARATOR[0x80:] = WORD_SEPARATOR[0x41:0x5B] = False
#: Ends of lines, and the marks with which languages open, carry on and close comments.
LINE_END = r"\n\r\v\f\x85\u2028\u2029"
MARK = r"(?:/\*+!?|\*+[/)]?|\(\*+|//+!?|#+|;+|%+|!+|>+|\|+|<!--+|--+>?|\.?\\\"|(?:rem|dnl)(?=\s))"
#: A run of white space; if a line ends in it, also a mark before that end and the marks at the starts of lines.
FOLDED = re.compile(rf"\s(?:(?:(?<=[{LINE_END}])|[^\S{LINE_END}]*(?:{MARK}[^\S{LINE_END}]*)?[{LINE_END}])(?:\s*{MARK})*\s*|\s*)")


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    weight: float
    keywords: tuple[str, ...]
    pattern: str


def _families() -> Iterator[Rule]:
    """Rules of license families, by variant, version and form."""
    terms = {"by": "attribution", "sa": "share-?\\s?alike", "nc": "non-?\\s?commercial", "nd": "no-?\\s?deriv(?:ative)?s?(?: works)?"}
    for variant in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
        parts = variant.split("-")
        short, full = r"[\s_-]+".join(parts), r"[\s,-]+".join(terms[p] for p in parts)
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0", ""):
            v = re.escape(version)
            label, more = f"cc-{variant}-{version}".rstrip("-"), 10 * len(parts) + 5 * bool(version)
            tail = rf"[\s_-]+(?:v|version )?{v}\b" if version else r"\b(?![\s_-]+(?:sa|nc|nd)\b)"
            yield Rule(label, 40 + more, 0.8, ("cc ", "cc-", "cc_"), rf"\bcc[\s_-]+{short}{tail}")
            yield Rule(label, 45 + more, 0.9, ("creative commons",), rf"\bcreative commons {full}" + (rf"[\s,-]+(?:v|version )?{v}(?: (?:international|unported|generic))?" if version else r"(?: licen[sc]e)?"))
            if version:
                yield Rule(label, 50 + more, 0.95, ("creativecommons.org",), rf"creativecommons\.org/licenses/{variant}/{v}")
    for version in ("1.0", ""):
        yield Rule(f"cc0-{version}".rstrip("-"), 60 + 5 * bool(version), 0.9, ("cc0",), r"\bcc0\b" + (rf"[\s_-]+{re.escape(version)}" if version else ""))
    yield Rule("cc0-1.0", 70, 0.95, ("creativecommons.org",), r"creativecommons\.org/publicdomain/zero/1\.0")
    names = {"gpl": "(?<!lesser )(?<!affero )(?<!library )general public", "lgpl": "(?:lesser|library) general public", "agpl": "affero general public"}
    for (name, words), version in product(names.items(), ("1", "2", "2.1", "3", "")):
        v = re.escape(version) + (r"(?:\.0)?" if version and "." not in version else "")
        label = f"{name}-{version if '.' in version else version + '.0'}" if version else name
        more = 10 * bool(version)
        yield Rule(label, 50 + more, 0.85, ("general public",), rf"\b(?:gnu )?{words} licen[sc]e" + (rf",? (?:as published by the free software foundation[,;]? )?(?:either )?(?:version|v\.?) ?{v}\b" if version else r"\b"))
        yield Rule(label, 45 + more, 0.8, (name,), rf"\b(?:gnu )?{name}" + (rf"[\s_-]?v?{v}\b" if version else r"\b"))
        if version:
            for suffix, form in (("-or-later", r"(?:-or-later|\+| or (?:any )?later)"), ("-only", r"-only")):
                yield Rule(label + suffix, 70 + more, 0.9, (name,), rf"\b{name}[\s_-]?v?{v}{form}")
            yield Rule(label, 65 + more, 0.9, ("gnu.org/licenses",), rf"gnu\.org/licenses/(?:old-licenses/)?{name}-{v}")


#: Identifiers of a tag line, of the licenses named above and some more.
TAGGED = ("mit", "isc", "zlib", "0bsd", "bsl-1.0", "epl-1.0", "epl-2.0", "mpl-1.1", "mpl-2.0", "cc0-1.0", "unlicense", "wtfpl", "artistic-2.0", "apache-1.1", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "cddl-1.0", "cddl-1.1", "eupl-1.1", "eupl-1.2", "ofl-1.1", "odbl-1.0", "postgresql", "python-2.0", "ncsa", "ms-pl", "ms-rl", "osl-3.0", "afl-3.0", "upl-1.0", "vim", "x11", "curl", "openssl", "ruby", "php-3.01", "w3c", "gfdl-1.3")


def rules() -> list[Rule]:
    """All rules, by falling priority and then by label and pattern."""
    out = [Rule(a, b, c, tuple(d.split("|")), e) for a, b, c, d, e in WRITTEN] + list(_families())
    out += [Rule(x, 95, 0.98, ("spdx-license-identifier",), rf"spdx-license-identifier:\s*{re.escape(x)}(?![\w.-])") for x in TAGGED]
    out += [Rule(x, 55, 0.7, (f"license: {x}", f"licence: {x}", f"license={x}", f"licence={x}"), rf"\blicen[sc]e(?:: |=){re.escape(x)}(?![\w.-])") for x in TAGGED]
    return sorted(out, key=lambda r: (-r.priority, r.label, r.pattern))


def surviving(found: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, int, str, float]]:
    """Detections (start, end, priority, label, weight) that lie within no other of at least their priority.

    Of equal intervals with equal priorities the one whose label comes first stays. Detections go in falling priority and
    length, and a tree over the starts tells how far those reach that start no later, so n of them take n log n steps.
    """
    starts = sorted({d[0] for d in found})
    reach = [0] * (len(starts) + 1)  # of node k, the furthest end kept among the starts that it covers
    kept: list[tuple[int, int, int, str, float]] = []
    for d in sorted(found, key=lambda d: (-d[2], d[0] - d[1], d[0], d[3])):
        at = k = bisect_left(starts, d[0]) + 1
        while k and reach[k] < d[1]:
            k -= k & -k
        if k:
            continue
        kept.append(d)
        while at < len(reach):
            reach[at] = max(reach[at], d[1])
            at += at & -at
    return sorted(kept)


def fold(text: str) -> str:
    """The text that rules are matched on."""
    return FOLDED.sub(" ", text)


def unfolded(found: list[tuple[int, int, int, str, float]], text: str) -> list[tuple[int, int, int, str, float]]:
    """Detections in a folded text, with starts and ends in the text that was folded."""
    at, shift = [], [0]  # each run's place in the folded text, what is left out before each
    for m in FOLDED.finditer(text):
        at.append(m.start() - shift[-1])
        shift.append(shift[-1] + m.end() - m.start() - 1)
    place = lambda k: k + shift[bisect_left(at, k)]
    return [(place(a), place(b - 1) + 1, *more) for a, b, *more in found]


class Scanner:
    def __init__(self):
        self.rules = [(r, re.compile(r.pattern)) for r in rules()]
        self.by_keyword: dict[str, list[int]] = {}
        for n, (r, _) in enumerate(self.rules):
            for k in r.keywords:
                self.by_keyword.setdefault(k, []).append(n)
        self.keywords = ahocorasick.Automaton()
        for k in self.by_keyword:
            self.keywords.add_word(k, k)
        self.keywords.make_automaton()
        gap = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
        inside = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
        self.base = [(p.split()[0].encode(), re.compile(rb"(?<!" + inside + rb")" + gap.join(p.encode().split()) + rb"(?!" + inside + rb")"), label) for p, label in BASE]

    def base_places(self, low: bytes) -> list[tuple[int, str]]:
        """(byte at which it starts, label) of each base phrase in a lower-cased text."""
        return sorted((m.start(), label) for word, pattern, label in self.base if word in low for m in pattern.finditer(low))

    def detect(self, low: bytes) -> list[tuple[int, int, int, str, float]]:
        text = low.decode("utf-8", "replace")
        folded = fold(text)
        open_rules = self.opened(folded)
        if not open_rules:
            return []
        found = surviving([(*m.span(), r.priority, r.label, r.weight) for r, p in (self.rules[n] for n in open_rules) for m in p.finditer(folded)])
        return found if len(folded) == len(text) else unfolded(found, text)

    def opened(self, folded: str) -> list[int]:
        """The rules of which a folded text has a keyword."""
        return sorted({n for k in {k for _, k in self.keywords.iter(folded)} for n in self.by_keyword[k]})


_scanner: list[Scanner] = []
SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:int,end:int,priority:int,label:string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _scanner:
        _scanner.append(Scanner())
    scanner = _scanner[0]
    for batch in batches:
        for lo, hi, buf, offsets in textbuf.slices(batch.column(1), 1 << 20):
            low = textbuf.LOWER[buf]
            starts, _, doc = textbuf.words(low, offsets, WORD_SEPARATOR)
            count = np.bincount(doc, minlength=hi - lo)
            before = np.concatenate([[0], np.cumsum(count)])
            columns: list[list] = [[] for _ in range(7)]
            for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                one = low[a:b].tobytes()
                base, found = scanner.base_places(one), scanner.detect(one)
                at = [int(np.searchsorted(starts, a + p) - before[k]) for p, _ in base]
                names = sorted({label for _, label in base})
                weight = {d[3]: d[4] for d in sorted(found, key=lambda d: d[4])} | dict.fromkeys(names, 0.9)
                row = (len(base), min(at, default=None), max(at, default=None), ",".join(names), ",".join(sorted(weight)), 1 - float(np.prod([1 - w for w in weight.values()])) if weight else 0.0, [dict(zip(("start", "end", "priority", "label"), d[:4], strict=True)) for d in found])
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("priority", pa.int32()), ("label", pa.string())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(count, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each text: words, base phrases, labels, score and the detections that survive.

    Only A-Z are lower-cased. first_word and last_word number words from 0 and are null where no
    base phrase stands. score is 1 less the product of (1 - weight) over the labels: 0 without any. Detections'
    start and end count characters. Null texts count as empty; null and repeated ids are kept.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scan, SCANNED)
