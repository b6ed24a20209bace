"""License scan: template markup compiled to token automata.

A template is plain wording with two kinds of region: ``[[ ... ]]`` may be missing, and ``<<n>>`` stands for any n
or fewer words. Everything else is mandatory and must match word for word. All templates share one automaton, whose
states are sets of places in templates; it is built as words are met, and its memory is bounded by STATES_MOST.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import table, text_bytes

#: Phrase, label: places of these count as base matches.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label: template, in the public wording of the licences (fixed values). The words are compared after lower-casing and
#: splitting as the texts are. A label that ends in -notice or -grant is of a reference to a licence, or of the grant at
#: its head; the others take the whole mandatory wording.
TEMPLATES = {
    "cc-by-nc-notice": "[[this work is]] licensed under [[a | the]] [[creative commons]] cc by nc [[<<2>>]]",
    "cc-by-notice": "[[this work is]] licensed under [[a | the]] [[creative commons]] cc by 4 0 [[international license]]",
    "gpl-3.0-notice": "[[this <<3>> is]] licensed under the gnu [[lesser | affero]] general public license [[as published by the free software foundation]] version 3 [[0]]",
    "gpl-2.0-notice": "[[this <<3>> is]] licensed under the gnu [[lesser]] general public license [[as published by the free software foundation]] version 2 [[0]]",
    "apache-2.0-notice": "licensed under the apache license version 2 0 [[the license you may not use this file except in compliance with the license]]",
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[http | https]] www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "[[this <<3>> is]] [[released | licensed]] under the mit license",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the [[authors or copyright holders | <<8>>]] be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted [[provided that the following conditions are met]]",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[[[3]] neither the name of <<10>> nor the names of [[its | his | her | the]] contributors may be used to endorse or promote products derived from this software without specific prior written permission]] this software is provided by <<8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at [[http | https]] [[mozilla org mpl 2 0 | www mozilla org mpl 2 0]]",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "copyright-notice": "copyright [[c]] <<6>> all rights reserved",
}

STATES_MOST = 20_000
_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    return text.translate(_SPLIT).split()


def _parse(template: str) -> list:
    """Sequence of words, int (a gap of so many words at most) and lists of alternatives (an optional region)."""
    out: list[list] = [[[]]]
    for part in re.findall(r"\[\[|\]\]|\||<<\d+>>|[^\s\[\]|<>]+", template):
        if part == "[[":
            out.append([[]])
        elif part == "]]":
            done = out.pop()
            out[-1][-1].append(done)
        elif part == "|":
            out[-1].append([])
        else:
            out[-1][-1].append(int(part[2:-2]) if part[:2] == "<<" else part.encode())
    return out[0][0]


class Automaton:
    """Accepts every place where a template ends; places in templates are states of an NFA, sets of them of a DFA."""

    def __init__(self, templates: dict[str, str]):
        self.step: list[dict[bytes, set[int]]] = []  # by word
        self.any: list[set[int]] = []  # by any word
        self.free: list[set[int]] = []  # without a word
        self.accepts: dict[int, str] = {}
        starts = set()
        for label, template in templates.items():
            start = self._state()
            starts.add(start)
            self.accepts[self._compile(_parse(template), start)] = label
        self.start = self._closure(starts)
        self.known: dict[tuple[frozenset, bytes], frozenset] = {}
        self.words = {w for s in self.step for w in s}
        # a word that each template can't do without; a template of regions only may match anywhere
        needed = [max((x for x in _parse(t) if isinstance(x, bytes)), key=len, default=None) for t in templates.values()]
        self.needed = None if None in needed else [b" %s " % w for w in sorted(set(needed))]

    def _state(self) -> int:
        self.step.append({})
        self.any.append(set())
        self.free.append(set())
        return len(self.step) - 1

    def _compile(self, sequence: list, at: int) -> int:
        for part in sequence:
            to = self._state()
            if isinstance(part, bytes):
                self.step[at].setdefault(part, set()).add(to)
            elif isinstance(part, int):
                for _ in range(part):
                    self.free[at].add(to)
                    nxt = self._state()
                    self.any[at].add(nxt)
                    at = nxt
                self.free[at].add(to)
            else:
                self.free[at].add(to)
                for choice in part:
                    self.free[self._compile(choice, at)].add(to)
            at = to
        return at

    def _closure(self, states: set[int]) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    def _next(self, states: frozenset, word: bytes) -> frozenset:
        word = word if word in self.words else b""
        if (got := self.known.get((states, word))) is None:
            reach = set().union(*(self.step[s].get(word, ()) for s in states), *(self.any[s] for s in states))
            got = self._closure(reach) | self.start
            if len(self.known) >= STATES_MOST:
                self.known.clear()
            self.known[states, word] = got
        return got

    def labels(self, words: list[bytes]) -> set[str]:
        """Labels of the templates that match somewhere in words."""
        found, now = set(), self.start
        for w in words:
            now = self._next(now, w)
            found.update(self.accepts[s] for s in now if s in self.accepts)
        return found


def scan(words: list[bytes], automaton: Automaton, base: dict[bytes, str]) -> tuple[int, int | None, int | None, set[str], set[str]]:
    """Base places, smallest and largest start, base labels, labels of the automaton."""
    line = b" " + b" ".join(words) + b" "
    starts, labels = [], set()
    for phrase, label in base.items():
        at = line.find(phrase)
        while at >= 0:
            starts.append(line.count(b" ", 0, at))
            labels.add(label)
            at = line.find(phrase, at + 1)
    tried = automaton.needed is None or any(w in line for w in automaton.needed)
    more = automaton.labels(words) if tried else set()
    return len(starts), min(starts, default=None), max(starts, default=None), labels, more


def score_of(own: set[str], more: set[str]) -> float:
    """How sure labels of base phrases and of templates make a licence."""
    if any(not x.endswith(("-notice", "-grant")) for x in more):
        return 1.0
    return 0.75 if more else 0.5 if own else 0.0


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """One row per row of df: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null or empty text has no words, empty labels, null first_word and last_word, and score 0. The id may be null or
    repeated; each row is scanned by itself, a very long text whole. Templates and phrases that end at one place, and
    those that overlap, all count. A template without words in it, or one that may be missing whole, matches every text
    that has a word. Other columns of df, whatever their names, are not read. score: 1 where a licence's whole wording
    matches, 0.75 where a -notice or -grant does, 0.5 where only base phrases do, else 0. Without rows the result is empty.
    """
    templates, base = TEMPLATES if templates is None else templates, BASE if base is None else base
    phrases = {b" " + k.encode() + b" ": v for k, v in base.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(templates)
        for batch in batches:
            rows = []
            for text in text_bytes(batch.column("text")):
                words = words_of(text)
                n, first, last, own, more = scan(words, automaton, phrases)
                rows.append((len(words), n, first, last, ",".join(sorted(own)), ",".join(sorted(own | more)), score_of(own, more)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """license_scan over table documents with TEMPLATES and BASE."""
    return license_scan(table(spark, sf_dir, "documents"))


#: The scan as far as regular expressions express it: optional regions and gaps become groups over the joined words.
def oracle(templates: dict[str, str] | None = None) -> str:
    templates = TEMPLATES if templates is None else templates

    def pattern(sequence: list) -> str:
        out = ""
        for part in sequence:
            if isinstance(part, bytes):
                out += re.escape(part.decode()) + " "
            elif isinstance(part, int):
                out += f"([^ ]+ ){{0,{part}}}"
            else:
                out += "(" + "|".join(pattern(choice) for choice in part) + ")?"
        return out

    method = ", ".join(f"CASE WHEN regexp_matches(line, ' {pattern(_parse(t))}') THEN '{k}' END" for k, t in templates.items())
    counts = {label: f"list_filter(range(1, len(w) + 1), lambda i: array_to_string(w[i:i + {len(p.split()) - 1}], ' ') = '{p}')" for p, label in BASE.items()}
    return f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
places AS (
  SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line, {', '.join(f'{sql} AS p{i}' for i, sql in enumerate(counts.values()))} FROM words),
found AS (
  SELECT doc_id, len(w) AS n_words, list_concat(list_concat(p0, p1), p2) AS p,
    list_filter([{', '.join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, label in enumerate(counts))}], lambda x: x IS NOT NULL) AS own,
    list_filter([{method}], lambda x: x IS NOT NULL) AS more
  FROM places)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(list_min(p) - 1 AS BIGINT) AS first_word, CAST(list_max(p) - 1 AS BIGINT) AS last_word,
  array_to_string(list_sort(own), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(own, more))), ',') AS labels,
  CASE WHEN len(list_filter(more, lambda x: NOT ends_with(x, '-notice') AND NOT ends_with(x, '-grant'))) > 0 THEN 1.0 WHEN len(more) > 0 THEN 0.75 WHEN len(own) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM found"""
