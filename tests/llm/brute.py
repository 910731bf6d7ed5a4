"""Plain Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import base64
import datetime
import hashlib
import math
import re
import unicodedata
from collections import defaultdict
from zlib import crc32

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UP, LOW)
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def size(text: str | None) -> int:
    return len(SPACE_WORD.findall(text or ""))


def targets(docs, weights=(5, 2, 1), budget=1.5, most=2.0) -> dict:
    """source -> (size, target) by resharing until none is above."""
    total = defaultdict(int)
    for d in docs:
        total[d["source"]] += size(d["text"])
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), budget * sum(total.values())
    while open_:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > most * total[s]]
        if not over:
            target |= {s: left * weight[s] / w for s in open_}
            break
        for s in over:
            target[s] = most * total[s]
            open_.discard(s)
        left = budget * sum(total.values()) - sum(target.values())
    return {s: (total[s], target[s]) for s in names}


def judged(url: str | None, rules) -> tuple:
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(ASCII_LOWER)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def hits(docs, items, width=13) -> dict:
    wins = defaultdict(set)
    for it in items:
        w = WORD.findall((it["text"] or "").translate(ASCII_LOWER))
        n = min(width, len(w))
        for i in range(len(w) - n + 1) if n else ():
            wins[tuple(w[i : i + n])].add(str(it["item_id"]))
    out = {}
    for d in docs:
        w = WORD.findall((d["text"] or "").translate(ASCII_LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if (t := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[t]
        out[d["doc_id"]] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def edited(docs) -> dict:
    rows = sorted(docs, key=lambda d: d["doc_id"])
    out = {}
    for i, d in enumerate(rows):
        t, nxt = d["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        q = len(t) // 4
        out[d["doc_id"]] = (len(t), sha(t[: len(t) - q] + nxt[:q]))
    return out


def warc(pages) -> dict:
    first = {}
    for p in pages:
        h = p["html"] or ""
        first[h] = min(first.get(h, p["page_id"]), p["page_id"])
    out = {}
    for p in pages:
        b = (p["html"] or "").encode()
        f = first[p["html"] or ""]
        same = f == p["page_id"]
        out[p["page_id"]] = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if same else "revisit", None if same else f)
    return out


def shingle_sets(docs, width=3) -> dict:
    out = {}
    for d in docs:
        w = SPACE_WORD.findall((d["text"] or "").translate(ASCII_LOWER))
        out[d["doc_id"]] = frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()
    return out


def near(docs, percent=85, width=3) -> dict:
    """doc_id -> (n_shingles, component): all pairs that share a shingle."""
    sets = shingle_sets(docs, width)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    by_set = defaultdict(list)
    for i, s in sets.items():
        if s:
            by_set[s].append(i)
    for ids in by_set.values():
        for i in ids:
            a, b = find(ids[0]), find(i)
            root[max(a, b)] = min(a, b)
    heads = {min(v): s for s, v in by_set.items()}
    freq = defaultdict(int)
    for s in heads.values():
        for x in s:
            freq[x] += 1
    index = defaultdict(list)
    for i, s in sorted(heads.items(), key=lambda x: len(x[1])):
        # Sets this similar share one of the rarest shingles.
        prefix = sorted(s, key=lambda x: (freq[x], x))[: len(s) - -(-percent * len(s) // 100) + 1]
        seen = set()
        for x in prefix:
            seen.update(j for j in index[x] if 100 * len(heads[j]) >= percent * len(s))
            index[x].append(i)
        for j in seen:
            if find(i) == find(j):
                continue
            t = heads[j]
            k = len(s & t)
            if 100 * k >= percent * (len(s) + len(t) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def chats(turns) -> dict:
    by = defaultdict(list)
    for t in turns:
        by[t["conv_id"]].append((t["turn"], t["role"] or "", t["text"] or ""))
    out = {}
    for c, ts in by.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        out[c] = (len(ts), sha("".join(f"{r}\n{x}\n" for _, r, x in ts)), len(loss), sha(loss))
    return out


def line_key(line: str) -> str:
    return line.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER)


def lines(docs, least_chars=20, least_docs=3) -> dict:
    found = defaultdict(set)
    for d in docs:
        for x in (d["text"] or "").split("\n"):
            if len(k := line_key(x)) >= least_chars:
                found[k].add(d["doc_id"])
    out = {}
    for d in docs:
        ls = (d["text"] or "").split("\n")
        kept = [x for x in ls if len(f := found.get(line_key(x), ())) < least_docs or max(f) == d["doc_id"]]
        out[d["doc_id"]] = (len(ls), len(ls) - len(kept), sha("\n".join(kept)))
    return out


def held_out(doc_id: int) -> bool:
    return crc32(str(doc_id).encode()) % 4 == 2


def _letters(text: str) -> list[str]:
    """Words of letters, each with the marks that follow its letters."""
    out, word = [], ""
    for c in unicodedata.normalize("NFC", text).lower() + " ":
        if c.isalpha() or (word and unicodedata.category(c)[0] == "M"):
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def _buckets(word: str, buckets: int = 1 << 15) -> list[int]:
    """The buckets of the 1- to 3-grams of <word>, by the hash that the model fixes."""
    mask, s, out = (1 << 64) - 1, f"<{word}>", []
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            h = 0
            for k in range(n):
                h = ((h + ord(s[i + k]) + k + 1) * 0x9E3779B97F4A7C15) & mask
                h ^= h >> 29
            out.append(h % buckets)
    return out


def _script(word: str, scripts) -> str:
    return [name for start, name in scripts if start <= ord(word[0])][-1]


def language_model(rows, scripts, buckets: int = 1 << 15) -> dict:
    """(text, lang) rows -> langs, log weights less their mean by bucket, and the languages of each script."""
    langs = sorted({x for _, x in rows})
    freq, chars = {x: defaultdict(int) for x in langs}, defaultdict(int)
    for text, lang in rows:
        for w in _letters(text):
            for b in _buckets(w):
                freq[lang][b] += 1
            chars[lang, _script(w, scripts)] += len(w)
    total = {x: sum(freq[x].values()) for x in langs}

    def weight(b: int) -> list[float]:
        raw = [math.log((freq[x][b] + 0.5) / (total[x] + 0.5 * buckets)) for x in langs]
        return [r - sum(raw) / len(raw) for r in raw]

    whole = {x: sum(v for (y, _), v in chars.items() if y == x) for x in langs}
    uses = {(x, s) for (x, s), v in chars.items() if v >= 0.01 * max(whole[x], 1)}
    return {"langs": langs, "weight": weight, "uses": uses}


def language_of(text: str | None, model: dict, scripts, penalty: float = 6.0, tau: float = 0.5) -> tuple[str, float]:
    """lang_pred and score of one text, word by word."""
    words, langs = _letters(text or ""), model["langs"]
    if not words or not langs:
        return "und", 0.0
    scores = []
    for w in words:
        grams = [model["weight"](b) for b in _buckets(w)]
        mean = [sum(g[i] for g in grams) / len(grams) * min(4.0, 1 + len(w) / 2) for i in range(len(langs))]
        fits = [(x, _script(w, scripts)) in model["uses"] for x in langs]
        scores.append([m if f else min(mean) - 2.0 for m, f in zip(mean, fits, strict=True)] if any(fits) else [0.0] * len(langs))
    paths = [(s, [i]) for i, s in enumerate(scores[0])]
    for s in scores[1:]:
        top = max(paths, key=lambda p: p[0])
        paths = [(max(v, top[0] - penalty) + s[i], (path if v >= top[0] - penalty else top[1]) + [i]) for i, (v, path) in enumerate(paths)]
    labels = max(paths, key=lambda p: p[0])[1]
    told = [any(s) for s in scores]
    mass = [sum(len(w) for w, y, t in zip(words, labels, told, strict=True) if t and y == i) for i in range(len(langs))]
    top = mass.index(max(mass))
    share = mass[top] / sum(map(len, words))
    own = [s for s, y, t in zip(scores, labels, told, strict=True) if t and y == top]
    if len(langs) == 1 or not own:
        return langs[top], share
    sums = [sum(s[i] for s in own) for i in range(len(langs))]
    margin = (sums[top] - max(v for i, v in enumerate(sums) if i != top)) / len(own)
    return langs[top], share * (1 - math.exp(-max(margin, 0) / tau))


# ---- pseudonyms --------------------------------------------------------------------------------------------------


def _stream(key: str, tag: str, n: int, part: str) -> str:
    return sha(f"{key}|{tag}{n}|{part}")


def _moved(text: str, stream: str, alphabets) -> str:
    out = ""
    for i, c in enumerate(text):
        k = int(stream[(i % 32) * 2 : (i % 32) * 2 + 2], 16) + i // 32
        found = next((a for a in alphabets if c in a), None)
        out += found[(found.index(c) + k) % len(found)] if found else c
    return out


def feistel_text(key: str, tag: str, text: str, alphabets, rounds: int = 8) -> str:
    left, right = text[: len(text) // 2], text[len(text) // 2 :]
    for r in range(rounds // 2):
        left = _moved(left, _stream(key, tag, 2 * r, right), alphabets)
        right = _moved(right, _stream(key, tag, 2 * r + 1, left), alphabets)
    return left + right


def feistel_pair(key: str, tag: str, a: int, b: int, size_a: int, size_b: int, rounds: int = 8) -> tuple[int, int]:
    number = lambda t, r, part, below: int(sha(f"{key}|{tag}{t}{r}|{part}")[:14], 16) % below
    for r in range(rounds // 2):
        a = (a + number("a", r, b, size_a)) % size_a
        b = (b + number("b", r, a, size_b)) % size_b
    return a, b


def luhn(digits: str) -> int:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


def _filled(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def pseudonym(key: str, kind: str, v: str) -> str | None:
    """A value's pseudonym by its kind; None where it is not valid."""
    only = re.sub("[^0-9]", "", v)
    nums = "0123456789"
    if kind == "card":
        if luhn(only):
            return None
        body = feistel_text(key, "card", only[:-1], (nums,))
        return _filled(v, body + next(c for c in nums if luhn(body + c) == 0))
    if kind == "phone":
        plus = v.startswith("+")
        full = only if plus else "1" + only
        if not 8 <= len(full) <= 15:
            return None
        short = {"1", "7", "20", "27"} | {str(x) for x in (*range(30, 35), 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98)}
        code = next(full[:n] for n in (1, 2, 3) if full[:n] in short or n == 3)
        new = feistel_text(key, "phone", full[len(code) :], (nums,))
        return _filled(v, code + new if plus else new)
    if kind == "ssn":
        area, group, serial = map(int, v.split("-"))
        if not 1 <= area <= 899 or area == 666 or not group or not serial:
            return None
        a, b = feistel_pair(key, "ssn", area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
        return f"{a + 1 + (a >= 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    if kind == "ip":
        o = [int(x) for x in v.split(".")]
        a, b = feistel_pair(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind == "date":
        cycle = (int(v[:4]) - 1800) // 400
        first = datetime.date(1800, 1, 1)
        try:
            days = (datetime.date.fromisoformat(f"{int(v[:4]) - 400 * cycle:04d}{v[4:]}") - first).days
        except ValueError:
            return None
        a, b = feistel_pair(key, "date", days // 773, days % 773, 189, 773)
        d = first + datetime.timedelta(a * 773 + b)
        return f"{d.year + 400 * cycle:04d}-{d.month:02d}-{d.day:02d}"
    if kind == "email":
        local, domain = v.split("@")
        new = feistel_text(key, "email", local.lower(), (nums, LOW))
        return "".join(c.upper() if o in UP else c for c, o in zip(new, local, strict=True)) + "@" + domain
    return feistel_text(key, "secret", v, ("0123456789ABCDEF" if re.search("[A-F]", v) else "0123456789abcdef",))


def spots(text: str | None, anchors, drawn, chain: int = 2) -> frozenset:
    """Spot signatures as tuples of words; ``drawn`` says which words are anchors besides the common ones."""
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    is_anchor = [w in anchors or drawn(w) for w in ws]
    if not any(is_anchor):
        return frozenset(tuple(ws[i : i + chain + 1]) for i in range(len(ws)))
    rest = lambda i: [w for w, x in zip(ws[i + 1 :], is_anchor[i + 1 :], strict=True) if not x]
    return frozenset((w, *rest(i)[:chain]) for i, w in enumerate(ws) if is_anchor[i])


def alike(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0
