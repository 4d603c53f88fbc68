"""Plain versions of the operators, on rows in memory."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc(ids) -> int:
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def encoded(name: str, texts: list[str | None]) -> list[list[int]]:
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    done = tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [e.ids for e in done]


def shard(key, n: int) -> int:
    def score(s: int) -> float:
        digest = hashlib.md5(f"{'' if key is None else key}:{s}".encode()).hexdigest()
        return -math.log((int(digest[:13], 16) + 0.5) / 16**13)

    return min(range(n), key=score)


def targets(docs, weights, most):
    """(doc_id, source, size) rows to {source: target}."""
    sizes = Counter()
    for _, source, size in docs:
        sizes[source] += size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full and sizes[s]]
        rest, share = total - sum(full.values()), sum(weight[s] for s in free)
        above = [s for s in free if rest * weight[s] / share > most * sizes[s]]
        if not above:
            return sizes, full | {s: rest * weight[s] / share for s in free} | {s: 0.0 for s in names if not sizes[s]}
        full |= {s: float(most * sizes[s]) for s in above}


def repeats(texts: dict[int, bytes], length: int = 100):
    """doc_id to the bytes that a string of ``length`` covers which also starts earlier."""
    seen: set[bytes] = set()
    out = {}
    for doc in sorted(texts):
        body = texts[doc]
        gone = bytearray(len(body))
        for i in range(len(body) - length + 1):
            part = body[i : i + length]
            if part in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(part)
        out[doc] = gone
    return out


def base_rules(text: str | None):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    hit = {p + k for places in windows.values() if len(places) > 1 for p in places for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


def repaired(rows):
    """(cost, audit, lines) of rows (role, text, fault: 0 none, 1 blank, 2 duplicate, 3 truncated), by trying all ways."""
    accepts = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    at = {0: (0, "", ())}

    def better(out, state, way):
        if state not in out or way < out[state]:
            out[state] = way

    def inserted(ways):
        out = dict(ways)
        for _ in range(4):
            for state, (cost, audit, lines) in list(out.items()):
                for role in ("user", "assistant"):
                    if role[0] in accepts[state]:
                        better(out, accepts[state][role[0]], (cost + 5, audit + "I", (*lines, f"{role}:")))
        return out

    for role, text, fault in rows:
        out = {}
        for state, (cost, audit, lines) in inserted(at).items():
            better(out, state, (cost + 2, audit + "D", lines))
            if fault in (1, 2):
                continue
            stays = 5 * (fault == 3)
            for edit, name in (("K", role), ("R", "user"), ("R", "assistant")):
                if name[:1] in accepts[state]:
                    way = (cost + stays + (edit == "R"), audit + edit, (*lines, f"{name}:{text}"))
                    better(out, accepts[state][name[:1]], way)
        at = out
    return min(v for k, v in inserted(at).items() if k in (0, 3))


def conversation(rows):
    """What ``repair`` says of one conversation's (turn, role, text) rows, and its repaired lines."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1:]
        fault = 1 if not last else 2 if (role, text) in seen else 3 if last not in ".!?" else 0
        seen.add((role, text))
        faults.append(fault)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, lines = repaired([(r, x, f) for (_, r, x), f in zip(rows, faults, strict=True)])
    return (gaps, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, audit), list(lines)


def audit_rows(docs, labels):
    """(part, order, step) to the seven counts, for rows (doc_id, text, lang) and labels (doc_id, quality, toxic)."""
    import itertools

    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    ids = defaultdict(list)
    for d, t, _ in docs:
        ids[t or ""].append(d)
    fails = []
    for d, t, lang in docs:
        t = t or ""
        words = WORD.findall(t)
        capitals = len(re.findall("[A-Z]", t))
        failed = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * capitals > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and any(o is not None and o < d for o in ids[t]),
        }
        fails.append((lang or "", {k for k, v in failed.items() if v}, d in good, d in toxic))
    out, shapley = {}, Counter()
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in itertools.permutations("ABCDE"):
            for i, name in enumerate(order):
                before = set(order[:i])
                here = [f for f in mine if name in f[1] and not f[1] & before]
                out[part, "".join(order), i + 1] = [
                    sum(not f[1] & (before | {name}) for f in mine), len(here),
                    sum(name in f[1] and bool(f[1] & before) for f in mine),
                    sum(f[1] == {name} for f in mine), sum(f[2] for f in here), sum(f[3] for f in here),
                ]
                shapley[part, name] += len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}
