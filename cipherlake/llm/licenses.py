"""Licence scan: Aho-Corasick finds notice phrases and identifier tags; a shunting-yard parser evaluates licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake.llm.common import slices

#: Phrases (words, lower case) and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
OWN = {
    "mit license": "mit", "apache license": "apache", "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd", "mozilla public license": "mpl", "lesser general public license": "lgpl", "affero general public license": "agpl",
    "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc0": "cc0", "creative commons attribution": "cc-by", "public domain": "public-domain", "isc license": "isc", "eclipse public license": "epl",
    "permission is hereby granted free of charge": "mit", "proprietary and confidential": "proprietary", "no part of this publication may be reproduced": "reserved",
}
TAG = "spdx license identifier"
#: How much a label speaks against free use: nothing, attribution only, share alike, closed.
WEIGHT = {"cc0": 0.05, "public-domain": 0.05, "mit": 0.1, "isc": 0.1, "bsd": 0.1, "apache": 0.1, "cc-by": 0.2, "mpl": 0.4, "epl": 0.4, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.7, "agpl": 0.8, "cc-by-nc": 0.8, "cc-by-nd": 0.8, "reserved": 0.95, "proprietary": 0.95}
_FAMILY = [("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("cc-by-nc", "cc-by-nc"), ("cc-by-nd", "cc-by-nd"), ("cc-by-sa", "cc-by-sa"), ("cc-by", "cc-by"), ("cc0", "cc0"), ("mit", "mit"), ("isc", "isc"), ("bsd", "bsd"), ("apache", "apache"), ("mpl", "mpl"), ("epl", "epl")]
_TAG_LINE = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*")
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def family(identifier: str) -> str:
    low = identifier.lower()
    return next((label for head, label in _FAMILY if low.startswith(head)), "other")


def parse_expression(text: str) -> list | str | None:
    """Tree of a licence expression (['or', a, b], ['and', a, b], ['with', licence, exception], identifier) by the shunting-yard method; None if malformed.

    WITH binds tightest, then AND, then OR. Reading ends before the first token that can't go on
    the expression, so prose or comment ends after a tag don't spoil it.
    """
    rank = {"or": 1, "and": 2, "with": 3}
    values: list = []
    marks: list[str] = []

    def reduce() -> bool:
        mark = marks.pop()
        if len(values) < 2 or mark == "(":
            return False
        b, a = values.pop(), values.pop()
        if mark == "with" and not (isinstance(a, str) and isinstance(b, str)):
            return False
        values.append([mark, a, b])
        return True

    operand = True
    for token in _TOKEN.findall(text):
        low = token.lower()
        if operand:
            if token == "(":
                marks.append("(")
            elif low in rank or token == ")":
                return None
            else:
                values.append(token)
                operand = False
        elif token == ")":
            while marks and marks[-1] != "(":
                if not reduce():
                    return None
            if not marks:
                break
            marks.pop()
        elif low in rank:
            while marks and marks[-1] != "(" and rank[marks[-1]] >= rank[low]:
                if not reduce():
                    return None
            marks.append(low)
            operand = True
        else:
            break
    if operand:
        return None
    while marks:
        if marks[-1] == "(" or not reduce():
            return None
    return values[0] if len(values) == 1 else None


def evaluate(tree: list | str) -> tuple[set[str], float]:
    """(labels, weight) of an expression: or takes the freest branch's weight, and the strictest, with an exception a fifth less.

    Works on a stack of its own: a chain of operators is a tree as deep as it is long.
    """
    labels: set[str] = set()
    values: list[float] = []
    todo: list = [tree]
    while todo:
        at = todo.pop()
        if isinstance(at, tuple):  # an operator whose operands are done
            kind = at[0]
            if kind == "with":
                values[-1] *= 0.8
            else:
                y, x = values.pop(), values.pop()
                values.append(min(x, y) if kind == "or" else max(x, y))
        elif isinstance(at, str):
            label = family(at)
            labels.add(label)
            values.append(WEIGHT.get(label, 0.5))
        else:
            todo += [(at[0],), *([] if at[0] == "with" else [at[2]]), at[1]]
    return labels, values[0]


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for phrase, what in [*((p, (p, label, True)) for p, label in BASE.items()), *((p, (p, label, False)) for p, label in OWN.items()), (TAG, (TAG, None, False))]:
        out.add_word(f" {phrase} ", what)
    out.make_automaton()
    return out


def normal_texts(texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Words of each text in lower case, one space before and after each, and their number; words are runs of digits, letters and non-ASCII characters."""
    low = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = pc.utf8_trim(pc.replace_substring_regex(low, _NOT_WORD, " "), " ")
    n = np.asarray(pc.count_substring(flat, " "), dtype=np.int64) + np.asarray(pc.not_equal(flat, "")).astype(np.int64)
    return [f" {t} " for t in flat.to_pylist()], n


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Licence notices of each whole text of docs (doc_id, text, ...): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions.

    n_base counts all places of the base phrases, first_word and last_word are the smallest and
    largest word number at which one starts (null without one). labels adds those of further
    phrases and of tagged licence expressions; expressions lists the parsed ones. score is
    1 - product of (1 - weight) over the labels, an expression counting by its evaluation: 0 for no
    notice. Null and empty texts have no word. Repeated rows get a row each; an empty table gives
    no rows; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton()
        for whole in batches:
            for batch in slices(whole):
                flat, n = normal_texts(batch.column("text"))
                out = {k: [] for k in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions")}
                for i, t in enumerate(flat):
                    places, base, own, tagged, shown, weights = [], set(), set(), False, [], {}
                    spaces = upto = 0
                    for end, (phrase, label, is_base) in found.iter(t):
                        if is_base:
                            spaces += t.count(" ", upto, end + 1)
                            upto = end + 1
                            places.append(spaces - 2 - phrase.count(" "))
                            base.add(label)
                        elif label:
                            own.add(label)
                        else:
                            tagged = True
                    for label in base | own:
                        weights[label] = WEIGHT.get(label, 0.5)
                    if tagged:
                        for m in _TAG_LINE.finditer(batch.column("text")[i].as_py()):
                            tree = parse_expression(m[1])
                            if tree is not None:
                                labels, weight = evaluate(tree)
                                own |= labels
                                shown.append(m[1].strip())
                                weights[m[1]] = weight
                    out["n_base"].append(len(places))
                    out["first_word"].append(min(places, default=None))
                    out["last_word"].append(max(places, default=None))
                    out["base_labels"].append(",".join(sorted(base)))
                    out["labels"].append(",".join(sorted(base | own)))
                    out["score"].append(float(1 - np.prod([1 - w for _, w in sorted(weights.items())])) if weights else 0.0)
                    out["expressions"].append(shown)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *(pa.array(v, k) for v, k in zip(out.values(), kinds))], names=["doc_id", "n_words", *out])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>")
