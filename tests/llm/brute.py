"""The contracts written out plainly, for small inputs."""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

WHITE = " \t\n\x0b\x0c\r"


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def lower(x: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x)


def words(x: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", x)


def exact(docs):
    """[(doc_id, keep_id, group_size, text_sha256)] and the number of kept rows a digest."""
    groups = defaultdict(list)
    for i, t in docs:
        t = t or ""
        groups[sha("".join(c for c in t if c not in WHITE))].append((-len(t), i is None, i or 0, i))
    return [(i, min(g)[3], len(g), h) for h, g in groups.items() for *_, i in g]


def lines(docs, least=40, many=5):
    key = lambda x: lower(x.strip(WHITE))
    holders, top = Counter(), {}
    for i, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least:
                holders[k] += 1
                if i is not None:
                    top[k] = max(top.get(k, i), i)
    out = []
    for i, t in docs:
        every = (t or "").split("\n")
        kept = [x for x in every if not (holders[key(x)] >= many and key(x) in top and (i is None or i < top[key(x)]))]
        out.append((i, len(every), len(every) - len(kept), sha("\n".join(kept))))
    return out


def warc(pages):
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in pages:
        html = html or ""
        least = first.get(html)
        revisit = least is not None and i != least
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        out.append((i, len(html.encode()), digest, "revisit" if revisit else "response", least if revisit else None))
    return out


def fingerprint(text) -> int:
    w = words(lower(text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


_U64 = (1 << 64) - 1


def simhash(text) -> int:
    """The weighted SimHash of five-word terms: word hashes times odd numbers by place, added and mixed."""
    w = words(lower(text or ""))
    weight = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {}
    votes = [0] * 64
    for term, n in weight.items():
        h = sum(xxhash.xxh64_intdigest(x.encode()) * (0x9E3779B97F4A7C15 + 2 * 0x1234567 * i) for i, x in enumerate(term)) & _U64
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ h >> 33) * factor & _U64
        h ^= h >> 33
        for b in range(64):
            votes[b] += n if h >> b & 1 else -n
    return sum(1 << b for b in range(64) if votes[b] > 0)


def _squash(x: float) -> float:
    x = max(-3.0, min(3.0, x))
    return x * (27 + x * x) / (27 + 9 * x * x)


def _walk(table, state, data):
    """The states after each byte, from a zero state."""
    cells = len(state) // 3
    h, out = [0.0] * cells, []
    for byte in data:
        own = [sum(float(state[i][j]) * h[j] for j in range(cells)) for i in range(3 * cells)]
        given = [float(table[i][byte]) for i in range(3 * cells)]
        gate = [0.5 + 0.5 * _squash(0.5 * (given[i] + own[i])) for i in range(2 * cells)]
        new = [_squash(given[2 * cells + i] + gate[cells + i] * own[2 * cells + i]) for i in range(cells)]
        h = [gate[i] * h[i] + (1 - gate[i]) * new[i] for i in range(cells)]
        out.append(h)
    return out


def per_position(arrays, data: bytes, n: int):
    """The classes' probabilities at each of the first n positions of a segment; both directions see all of it."""
    ahead = _walk(arrays[0], arrays[1], data)
    back = _walk(arrays[2], arrays[3], data[::-1])[::-1]
    for t in range(n):
        both = ahead[t] + back[t]
        score = [math.exp(sum(float(w) * x for w, x in zip(row, both, strict=True)) + float(bias[0])) for row, bias in zip(arrays[4], arrays[5], strict=True)]
        yield [x / sum(score) for x in score]


def positions(arrays, data: bytes, n: int):
    """The sums of the probabilities over the first n positions."""
    every = list(per_position(arrays, data, n))
    return [sum(p[k] for p in every) for k in range(len(arrays[4]))]


def groups(prints, radius=3):
    """The component of each position."""
    at = list(range(len(prints)))

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                at[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(prints))]


def near(docs):
    prints = [fingerprint(t) for _, t in docs]
    own = groups(prints)
    least = defaultdict(list)
    for (i, _), g in zip(docs, own, strict=True):
        if i is not None:
            least[g].append(i)
    return [(i, format(p, "016x"), min(least[g], default=None)) for (i, _), p, g in zip(docs, prints, own, strict=True)]


_KEYWORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key"))
_BASE = (
    (re.compile(rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
)


def secrets(text):
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(_BASE) for m in p.finditer(text or "") if ok(m))


_CONTROL = re.compile(r"([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)")


def chat(turns):
    """[(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)] of (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    escape = lambda x: _CONTROL.sub(r"\1\\\2\3", x)
    for conv, rows in by.items():
        rows.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in rows)
        loss = "".join(t for *_, r, t in rows if r == "assistant")
        shown = "".join("<|im_start|>" + escape(r.replace("%", "%25").replace("\n", "%0A")) + "\n" + escape(t) + "<|im_end|>\n" for *_, r, t in rows)
        out.append((conv, len(rows), sha(said), len(loss), sha(loss), len(shown)))
    return out
