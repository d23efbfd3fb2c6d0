"""Plain versions of the operators, for small corpora."""

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(lower(text or ""))


def windows(texts, length):
    """n_bytes, n_removed, n_spans, sha of what stays."""
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def groups(ids, sets, percent=80):
    up = {k: k for k in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def unigram(corpus, held_out):
    w = {k: [*words(t), None] for k, t in corpus}
    c = collections.Counter(x for k, v in w.items() if not held_out(k) for x in v)
    n, v = sum(c.values()), len(c)
    return {k: (len(x), sum(c[y] > 0 for y in x), n, sum(math.log10((c[y] + 1) / (n + v + 1)) for y in x)) for k, x in w.items()}


def suffix_tree(texts, train, min_word, min_context=2, order=3, gain=10.0, discount=0.75, often_from=1):
    """log10 probability of each text by the tree over words and word classes that grows from the training texts, and the
    number of nodes. Words met less than often_from times share one probability in the root."""
    tail = lambda w: lower(w).encode()[-2:]
    c = collections.Counter(w for t in train for w in words(t))
    own = {w for w in c if c[w] >= min_word}
    classes, kinds = collections.Counter(), collections.Counter()
    for w in c:
        if w not in own:
            classes[tail(w)] += c[w]
            kinds[tail(w)] += 1
    named = {t for t in classes if classes[t] >= min_word}
    symbol = lambda w: w if w in own else (tail(w) if tail(w) in named else "rest") if w is not None else ()
    mass = sum(c.values()) + len(c) + len(train) + 1 + len(named) + 2
    further = [w for w in own if c[w] < often_from]
    mean = (sum(c[w] + 1 for w in further) + 1) / (len(further) + 1) / mass
    root = {w: (c[w] + 1) / mass if c[w] >= often_from else mean for w in own} | {t: (classes[t] + kinds[t] + 1) / mass for t in named}
    root["rest"] = (sum(classes[t] + kinds[t] for t in classes if t not in named) + 1) / mass
    root[()] = (len(train) + 1) / mass
    after = collections.defaultdict(collections.Counter)
    for t in train:
        s = [(), *(symbol(w) for w in words(t)), ()]
        for i in range(1, len(s)):
            for k in range(1, min(order, i) + 1):
                after[tuple(s[i - k : i])][s[i]] += 1
    nodes = set()

    def p(context, x):
        while context and context not in nodes:
            context = context[1:]
        if not context:
            return root[x]
        n = after[context]
        kept = [y for y in n if n[y] > 1]
        single = sum(n.values()) - sum(n[y] for y in kept)
        return (max(n[x] - discount, 0) * (n[x] > 1) + (single + discount * len(kept)) * p(context[1:], x)) / sum(n.values())

    for context in sorted(after, key=len):
        n, total = after[context], sum(after[context].values())
        kept = [y for y in n if n[y] > 1]
        if total < min_context or not kept:
            continue
        single = total - sum(n[y] for y in kept)
        won = sum(n[y] * math.log(n[y] / total / p(context[1:], y)) for y in kept)
        if single:
            won += single * math.log(single / total / max(1 - sum(p(context[1:], y) for y in kept), 1e-9))
        if won > 0.5 * (len(kept) + (single > 0)) * math.log(total) + gain:
            nodes.add(context)
    out = []
    for t in texts:
        w = [*words(t), None]
        s = [(), *(symbol(x) for x in w)]
        score = sum(math.log10(p(tuple(s[max(0, i - order) : i]), s[i]) / root[s[i]]) for i in range(1, len(s)))
        base = lambda x: root[()] if x is None else mean if x in own and c[x] < often_from else (c[x] + 1) / mass
        out.append(score + sum(math.log10(base(x)) for x in w))
    return out, len(nodes)


def fold(key, modulus):
    return zlib.crc32(str(key).encode()) % modulus
