"""Plain single-process versions of the queries' contracts: lists of rows in, dictionaries by id out."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from html import unescape

import xxhash

from terrane.llm import html as html_operator

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOWER = {c: c + 32 for c in range(65, 91)}


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def utf8(text) -> bytes:
    return (text or "").encode()


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans."""
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(BASE[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and _luhn(digits), "phone": 10 <= len(digits) <= 15}
            if fine[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def personal_digest(text) -> tuple:
    spans = personal(text)
    counts = tuple(sum(s[1] == k for s in spans) for k in range(4))
    joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return (*counts, hashlib.sha256(joined.encode()).hexdigest()), spans


def language_base(rows: list[tuple]) -> dict:
    """(doc_id, text) -> {row number: (held_out, n_tokens, n_known, N, base_score)}."""
    tokens = [SPACE.findall((t or "").translate(LOWER)) + [None] for _, t in rows]
    held = [i is not None and crc(i) % 7 == 2 for i, _ in rows]
    count = Counter(x for t, h in zip(tokens, held, strict=True) if not h for x in t)
    n, v = sum(count.values()), len(count)
    return {k: (h, len(t), sum(count[x] > 0 for x in t), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t)) for k, (t, h) in enumerate(zip(tokens, held, strict=True))}


def fingerprint(text) -> int:
    words = SPACE.findall((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def near_classes(rows: list[tuple]) -> list[tuple]:
    """(doc_id, text) -> (doc_id, fingerprint, component) in order."""
    prints = [fingerprint(t) for _, t in rows]
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least: dict = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    return [(i, f"{p:016x}", least.get(root(p))) for (i, _), p in zip(rows, prints, strict=True)]


def nearest(rows: list[tuple], every: int = 50, k: int = 5) -> set[tuple]:
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in kept:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in kept if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


def mix_targets(sizes: dict, most: int = 3) -> dict:
    """source -> words -> target, by repeated resharing."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > most * sizes[s]}
        if not over:
            out |= {s: share * weight[s] for s in open_}
            break
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def _spark_hash(*values) -> int:
    """xxhash64 as Spark chains it over integers and strings; nulls change nothing."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.to_bytes(4, "little") if isinstance(v, int) else v.encode(), h)
    return h


def _hypergeometric(total: int, marked: int, drawn: int, u: float) -> int:
    """The smallest count whose cumulated probability is u."""
    every, summed = math.comb(total, drawn), 0
    for x in range(max(0, drawn - (total - marked)), min(drawn, marked) + 1):
        summed += math.comb(marked, x) * math.comb(total - marked, drawn - x)
        if summed >= u * every:
            return x
    return min(drawn, marked)


def splitting_tree(quotas: dict, shards: int, seed: int = 6) -> dict:
    """source -> quota in; source -> its part for each shard out."""
    names = sorted(quotas, key=lambda s: (s is not None, s or ""))

    def parts(low: int, high: int, held: dict) -> list[dict]:
        if high - low == 1:
            return [held]
        half, pool = (high - low) // 2, sum(held.values())
        seats, left = pool * half // (high - low), {}
        for s in names:
            u = ((_spark_hash(seed, low, high, s) >> 11) + 0.5) / (1 << 53)
            left[s] = _hypergeometric(pool, held[s], seats, u)
            pool, seats = pool - held[s], seats - left[s]
        return parts(low, low + half, left) + parts(low + half, high, {s: held[s] - left[s] for s in names})

    each = parts(0, shards, quotas)
    return {s: tuple(p[s] for p in each) for s in names}


def similar_classes(rows: list[tuple], least: float = 0.8, shingle: int = 5) -> list[int]:
    """(doc_id, text) -> the number of each row's component, by all pairs."""
    words = [SPACE.findall((t or "").translate(LOWER)) for _, t in rows]
    sets = [{tuple(w[a : a + shingle]) for a in range(max(1, len(w) - shingle + 1))} if w else set() for w in words]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root(i) != root(j) and min(len(a), len(b)) >= least * max(len(a), len(b)) and (a == b or len(a & b) >= least * len(a | b)):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(rows))]


def seating(counts: dict, words: int, theta: float = 1.0, d: float = 0.5, unknown: float = 0.5, sweeps: int = 30) -> tuple[list[int], list[int]]:
    """(context, word) -> count in; the number of tables of all contexts and of the parent after each sweep of single customers out."""
    rng, base = random.Random(5), (1 - unknown) / words
    child: dict = {k: [c] for k, c in counts.items()}
    of_context = Counter(u for u, _ in counts)
    parent = {w: [n] for w, n in Counter(w for _, w in counts).items()}
    total, all_parents = len(counts), len(parent)
    customers = total

    def leave(tables):
        x = rng.randrange(sum(tables))
        for i, n in enumerate(tables):
            if x < n:
                tables[i] -= 1
                if not tables[i]:
                    del tables[i]
                    return True
                return False
            x -= n

    def come(tables, new):
        x = rng.random() * (sum(tables) - d * len(tables) + new)
        for i, n in enumerate(tables):
            x -= n - d
            if x < 0:
                tables[i] += 1
                return False
        tables.append(1)
        return True

    out, above = [], []
    for _ in range(sweeps):
        for (u, w), tables in child.items():
            for _ in range(sum(tables)):
                if leave(tables):
                    of_context[u] -= 1
                    total, customers = total - 1, customers - 1
                    all_parents -= leave(parent[w])
                p0 = (sum(parent[w]) - d * len(parent[w]) + (theta + d * all_parents) * base) / (theta + customers)
                if come(tables, (theta + d * of_context[u]) * p0):
                    of_context[u] += 1
                    total, customers = total + 1, customers + 1
                    all_parents += come(parent[w], (theta + d * all_parents) * base)
        out.append(total)
        above.append(all_parents)
    return out, above


MARKUP = re.compile(r"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|</[A-Za-z][^>]*(?:>|$)|<[A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|$)", re.S)


class Page(dict):
    """An element read without the operator's reader: tag, attributes, parent, items (elements and texts)."""

    def chain(self) -> list:
        return (self["parent"].chain() if self["parent"] is not None else []) + [self]


def plain_tree(html: str) -> Page:
    """A tree of tags, texts joined and split again only by what the page's blocks are."""
    new = lambda tag, attrs, parent: Page(tag=tag, attrs=attrs, parent=parent, items=[])
    root = at = new("", {}, None)
    place = 0
    while place < len(html):
        m = MARKUP.search(html, place)
        at["items"].append(unescape(html[place : m.start() if m else len(html)]))
        if not m:
            break
        place, whole = m.end(), m[0]
        if whole.startswith("<!") or whole.startswith("<?") or not whole.endswith(">"):
            continue
        name = re.match(r"</?([^\s/>]+)", whole)[1].lower()
        if whole.startswith("</"):
            ups = at.chain()[1:]
            while ups and ups[-1]["tag"] != name:
                if ups[-1]["tag"] in ("article", "body", "td") and name not in ("article", "body", "html", "table", "tr", "main", "section", "div"):
                    ups = []
                    break
                ups.pop()
            at = ups[-1]["parent"] if ups else at
            continue
        attrs = {k.lower(): unescape(a or b or c or "") for k, a, b, c in re.findall(r"([A-Za-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", whole[1 + len(name) : -1])}
        if name in html_operator.VOID:
            at["items"].append(new(name, attrs, at))
            continue
        stops = html_operator.BLOCKS if name in html_operator.ENDS_P else {"ul", "ol", "dl", "table"}
        ends = {"p"} if name in html_operator.ENDS_P else html_operator.SAME.get(name, set())
        for e in reversed(at.chain()[1:]):
            if e["tag"] in ends:
                at = e["parent"]
                break
            if e["tag"] in stops:
                break
        child = new(name, attrs, at)
        at["items"].append(child)
        at = child
        if name in ("script", "style"):
            close = re.compile(f"</{name}", re.I).search(html, place)
            place = close.start() if close else len(html)
    return root


def page_texts(pages: list[tuple], least_pages: int = 8, threshold: float = 0.35, main_share: float = 0.2) -> list[str]:
    """(url, html) -> text: style trees as dictionaries of each host's different pages."""
    op = html_operator
    has = lambda e, words: any(
        any(w in words and not (i and parts[0] in op.HAVING) for i, w in enumerate(parts))
        for k in ("class", "id", "role") for t in e["attrs"].get(k, "").lower().split() if (parts := [w for w in re.split("[^a-z]+", t) if w])
    )
    shown = lambda e: e["tag"] + "".join("." + c for c in sorted(e["attrs"].get("class", "").split())) + (f"#{e['attrs']['id']}" if e["attrs"].get("id") and not re.search(r"\d", e["attrs"]["id"]) else "")
    block = lambda e: e["tag"] in op.BLOCKS

    def elements(e):
        yield e
        for x in e["items"]:
            if isinstance(x, Page):
                yield from elements(x)

    def judge(root):
        """What each element is: main or in it, hard, named; the first article counts whatever its name."""
        first = next((e for e in elements(root) if e["tag"] in ("article", "main")), None)
        for e in elements(root):
            up = e["parent"] or {"in_main": False, "among": False}
            named = e["tag"] not in ("html", "body", "")
            e["strong"], e["weak"] = named and has(e, op.STRONG), named and has(e, op.WEAK)
            among = up["among"] or e["strong"]
            e["main"] = e["tag"] in ("article", "main") and (e is first or not among)
            e["among"], e["in_main"], e["around"] = among and not e["main"], up["in_main"] or e["main"], False
            style = e["attrs"].get("style", "")
            e["hard"] = e["tag"] in op.NEVER or (e["tag"] == "header" and not up["in_main"]) or "hidden" in e["attrs"] or bool(re.search(r"display\s*:\s*none", style))
        for e in elements(root):
            if e["main"]:
                for x in e.chain()[:-1]:
                    x["around"] = True
        for e in elements(root):
            e["out"] = e["hard"] and not (e["around"] and e["tag"] == "form") or bool(e["parent"] and e["parent"]["out"])

    def own_part(e):
        return block(e) or e["hard"] or e["strong"] or e["weak"] and (e["tag"] == "a" or not e["in_main"])

    def blocks(e, out, parts):
        for x in e["items"]:
            if isinstance(x, str):
                parts.append(x)
                continue
            if own_part(x):
                flush(e, out, parts)
            if x["tag"] not in op.VOID:
                blocks(x, out, parts)
                if own_part(x):
                    flush(x, out, parts)
        return out

    def flush(e, out, parts):
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append((e, text))

    read = []
    for _, html in pages:
        root = plain_tree(html or "")
        judge(root)
        out, parts = [], []
        blocks(root, out, parts)
        flush(root, out, parts)
        for e in elements(root):
            e["below"] = []
        for e, t in out:
            for x in e.chain():
                x["below"].append((e, t))
        read.append((root, out))

    path = lambda e: tuple(shown(x) for x in e.chain() if block(x))
    under = lambda e: tuple((tuple(shown(x) for x in b.chain()[len(e.chain()) :]), t) for b, t in e["below"])
    hosts, trees = [], defaultdict(lambda: defaultdict(dict))
    for (url, _), (root, _) in zip(pages, read, strict=True):
        found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", url or "")
        hosts.append(found[1].lower() if found else "")
        page, seen = under(root), {}
        for e in elements(root):
            if block(e) and e["below"]:
                laid = []
                for b, _ in e["below"]:
                    inner = [x for x in b.chain()[len(e.chain()) :] if block(x)]
                    if inner and laid[-1:] != [shown(inner[0])]:
                        laid.append(shown(inner[0]))
                children, contents = seen.setdefault(path(e), ([], []))
                children.append(tuple(laid))
                contents.append(under(e))
        for p, (children, contents) in seen.items():
            trees[hosts[-1]][p][page] = (tuple(children), tuple(contents))
    importance: dict = {}
    for host, nodes in trees.items():
        for p, held in nodes.items():
            n = len(held)
            entropy = lambda k: -sum(c / n * math.log(c / n) for c in Counter(x[k] for x in held.values()).values()) / math.log(n) if n > 1 else 1.0  # noqa: B023, E731
            importance[host, p] = max(entropy(0), entropy(1)) if n >= least_pages else 1.0
    texts = []
    for host, (root, out) in zip(hosts, read, strict=True):
        half = sum(len(t) for e, t in out if not e["out"]) / 2
        for e in elements(root):
            prior = 2 if e["in_main"] else 1
            if not (e["main"] or e["around"]):
                if e["strong"] or e["weak"] and e["tag"] == "a" or e["weak"] and not block(e) and not e["in_main"]:
                    prior /= 6
                elif e["weak"] and block(e) and (e["in_main"] or sum(len(t) for _, t in e["below"]) < half):
                    prior /= 3
            score = prior * (importance.get((host, path(e)), 1.0) if block(e) else 1.0)
            e["gone"] = e["out"] or score < threshold - 1e-12 or bool(e["parent"] and e["parent"]["gone"])
        kept = [(e["in_main"], t) for e, t in out if not e["gone"]]
        if sum(len(t) for m, t in kept if m) >= main_share * sum(len(t) for _, t in kept):
            kept = [x for x in kept if x[0]] or kept
        texts.append(" ".join(t for _, t in kept))
    return texts


def repeats(rows: list[tuple], window: int = 13) -> list[tuple]:
    words = [SPACE.findall(t or "") for _, t in rows]
    first: dict = {}
    for (i, _), w in zip(rows, words, strict=True):
        if i is not None:
            for a in range(len(w) - window + 1):
                key = tuple(w[a : a + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        if i is not None:
            for a in range(len(w) - window + 1):
                if first[tuple(w[a : a + window])] < i:
                    gone.update(range(a, a + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def contaminated(rows: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall((t or "").translate(LOWER))
    of = defaultdict(set)
    for item, text in items:
        w = split(text)
        for a in range(max(1, len(w) - window + 1) if w else 0):
            of[tuple(w[a : a + window])].add("" if item is None else str(item))
    lengths = {len(p) for p in of}
    out = []
    for i, text in rows:
        w, hit, found = split(text), set(), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                if (p := tuple(w[a : a + n])) in of:
                    hit.update(range(a, a + n))
                    found |= of[p]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    counted = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for i, c, n in counted:
            m = 25 + 75 * n * n_docs // total
            score = sum(times * weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


LICENCE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def licences(texts: list, templates, phrases, most: int = 8, slack: int = 4, share: float = 0.7) -> list[tuple]:
    """Of each text n_words, n_base, first_word, last_word, base_labels, labels, score: every template is tried at every place."""
    read = [LICENCE_WORD.findall((t or "").translate(LOWER)) for t in texts]
    df = Counter(w for words in read for w in set(words))
    out = []
    for words in read:
        base = [(i, label) for i in range(len(words)) for phrase, label in phrases if words[i : i + len(phrase.split())] == phrase.split()]
        found = []
        for t in templates:
            own = t.text.split()
            rare = sorted(set(own), key=lambda w: (df[w], w))
            rare = rare[: max(3, min(most, len(rare) // 2))]
            if len(set(words) & set(rare)) == 0:
                continue
            for at in range(-len(own), len(words)):
                agree = sum(own[p] in rare and 0 <= at + p < len(words) and words[at + p] == own[p] for p in range(len(own)))
                near = words[max(0, at - slack) : max(0, at + len(own) + slack)]
                if agree >= max(2, len(rare) // 2) and all(f" {k} " in f" {' '.join(near)} " for k in t.keys):
                    part = len(set(own) & set(near)) / len(set(own))
                    found += [(t.label, part)] * (part >= share)
        labels = {label for _, label in base}
        places = [i for i, _ in base]
        score = 1.0 if base else max((p for _, p in found), default=0.0)
        out.append((len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {f for f, _ in found})), score))
    return out


def collocations(docs: list[tuple], longest: int = 5, least: int = 100, top: int = 2000) -> list[tuple]:
    """(lang, rank, phrase, a, l, r, n, score) from the counts of all phrases."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            counts[lang or "und"].update(tuple(words[i : i + m]) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        hidden = {q[i : i + m] for q, b in candidates.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if b >= candidates[q[i : i + m]]}
        rows = []
        for p, a in candidates.items():
            if p not in hidden:
                score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, totals[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return out
