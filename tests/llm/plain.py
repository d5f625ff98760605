"""Plain computations of what the operators return, for small inputs."""

from __future__ import annotations

import hashlib
import random

WORDS = "ash birch cedar elm fir hazel larch lime maple oak pine rowan".split()
#: Names that operators use inside.
CLASHES = ["size", "target", "taken", "row", "chunk", "key", "word", "ids", "print", "score", "document", "normal", "place", "copy"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def edge_documents(seed: int = 0, n: int = 60) -> list[tuple]:
    """Rows with nulls, empty, odd and long texts, copies, near copies and repeated rows."""
    dice = random.Random(seed)
    passage = " ".join(dice.choice(WORDS) for _ in range(70))
    texts = [None, "", " \n\t ", "a", "...", "\x1cx\x1d y z　w", "Ünïcödé straße ΑΣ Σ İ ǅ é K", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b"]
    texts += ["don't it's I'll WE'RE 'S x.y, z.,, (a). 3.5 10,000. é. “q”. end.", "٣ ½ ² x2y ᾳ 漢字かな 한국어 🙂🙂 a🙂b", "\r\n\x0b\x0c lead and trail \x0b"]
    while len(texts) < n:
        base = [dice.choice(WORDS) for _ in range(dice.randint(1, 60))]
        kind = dice.random()
        if kind < 0.3 and len(texts) > 15:
            base = (texts[dice.randint(11, len(texts) - 1)] or "x").split(" ")
            if kind < 0.2 and base:
                base[dice.randrange(len(base))] = "CHANGED"
        elif kind < 0.5:
            at = dice.randint(0, len(base))
            base = base[:at] + passage.split() + base[at:]
        texts.append(" ".join(base))
    texts.append("very " * 30_000 + "long")
    texts.append("x" * 50_000)
    rows = []
    for i, text in enumerate(texts):
        lang, source = dice.choice(["en", "de", None]), dice.choice(["s1", "s2", "S3", None, "ß"])
        rows.append((i * 3 + 1, text, lang, source, None, *("c" for _ in CLASHES)))
    rows += [rows[20], rows[20], rows[30], (None, *rows[25][1:]), (None, *rows[25][1:]), (rows[21][0], *rows[33][1:])]
    dice.shuffle(rows)
    return rows


def later_windows(rows: list[tuple], length: int, words: bool) -> list[tuple]:
    """(doc_id, units, removed, spans, sha256 of the rest) of each (doc_id, text)."""
    units = [((t or "").encode().split() if words else list((t or "").encode())) for _, t in rows]
    order = [2**63 - 1 if i is None else i for i, _ in rows]
    first: dict = {}
    for d, u in zip(order, units):
        for s in range(len(u) - length + 1):
            w = tuple(u[s : s + length])
            first[w] = min(first.get(w, (2**64, 0)), (d, s) if words else (d, 0))
    out = []
    for (doc_id, _), d, u in zip(rows, order, units):
        gone = [False] * len(u)
        for s in range(len(u) - length + 1):
            f = first[tuple(u[s : s + length])]
            if f < ((d, s) if words else (d, 0)):
                gone[s : s + length] = [True] * length
        rest = [x for x, g in zip(u, gone) if not g]
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(u), sum(gone), spans, hashlib.sha256(b" ".join(rest) if words else bytes(rest)).hexdigest()))
    return out


def sorted_rows(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=repr)
