"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs,
digits, URL schemes and identifier cues. At each anchor a small deterministic
parser expands to the boundaries of the candidate and validates it. A parser
never looks at a place that an earlier candidate of its kind has used, which
makes the results equal to a leftmost, non-overlapping search.

Null and empty texts have no spans. Positions count code points, ends are
exclusive; spans are ordered by kind, then start, and no two of a kind start alike.
Repeated rows give repeated results, an empty table an empty one. Time is linear in
the length of a text, however its digits, dots and signs are arranged. Only the id
and text columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from .textio import map_texts

BASE = ("email", "ip", "card", "phone")
ADDED = ("login", "iban")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"://([^\s/@:]+:[^\s/@]+)@[A-Za-z0-9]")
IBAN = re.compile(r"(?i:iban)[\s:=#]*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(value: str) -> bool:
    v = value.replace(" ", "").upper()
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def quads(chain: str, at: int) -> list[tuple[int, int]]:
    """Spans of each four groups of a chain of numbers and dots that are an address; ``at`` is where it starts."""
    out, groups = [], chain.split(".")
    for k in range(0, len(groups) - 3, 4):
        four = groups[k : k + 4]
        size = sum(map(len, four)) + 3
        if all(len(g.lstrip("0")) <= 3 and int(g) <= 255 for g in four):
            out.append((at, at + size))
        at += size + 1
    return out


def anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("email", "@"), ("phone", "+"), ("digit", "0123456789")):
        for w in words:
            found.add_word(w, (kind, 1))
    found.add_word("://", ("login", 3))
    for w in ("IBAN", "iban", "Iban"):
        found.add_word(w, ("iban", 4))
    found.make_automaton()
    return found


def find(text: str, automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in order of their starts."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE + ADDED}
    done = dict.fromkeys(out, 0)
    for last, (kind, n) in automaton.iter(text):
        at = last - n + 1
        if kind == "digit":
            if at >= done["ip"]:
                m = DOTTED.match(text, at)
                done["ip"] = m.end()
                out["ip"] += quads(m[0], at)
            if at >= done["card"]:
                m = CARD.match(text, at)
                done["card"] = m.end() if m else at + 1
                if m and 13 <= len(digits := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        elif at < done[kind]:
            continue
        elif kind == "email":
            left = at
            while left > done["email"] and text[left - 1] in LOCAL:
                left -= 1
            if left < at and (m := DOMAIN.match(text, at + 1)):
                out["email"].append((left, m.end()))
                done["email"] = m.end()
        elif kind == "phone":
            if m := PHONE.match(text, at):
                done["phone"] = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out["phone"].append(m.span())
        elif kind == "login":
            if m := LOGIN.match(text, at):
                out["login"].append(m.span(1))
                done["login"] = m.end()
        elif (m := IBAN.match(text, at)) and iban_ok(m[1]):
            out["iban"].append(m.span(1))
            done["iban"] = m.end()
    return out


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id and ``found``, an array of (kind, start, end) by kind, then start."""

    def start():
        automaton = anchors()

        def work(ids, texts):
            rows = []
            for text in texts.to_pylist():
                spans = find(text, automaton) if text else {}
                rows.append([{"kind": k, "start": a, "end": b} for k in BASE + ADDED for a, b in spans.get(k, ())])
            return {"id": ids, "found": rows}

        return work

    return map_texts(docs, id_col, text_col, start, "id long, found array<struct<kind:string,start:int,end:int>>").withColumnRenamed("id", id_col)


def digest(spans: list[dict]) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
