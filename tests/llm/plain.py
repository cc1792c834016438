"""Plain Python versions of the operators, for small inputs."""

import functools
import hashlib
import itertools
import re
from re import _constants, _parser

import xxhash

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_pii(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    checks = [
        ("email", EMAIL, lambda m: True),
        ("ip", IP, lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", CARD, lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", PHONE, lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(kind, m.start(), m.end()) for kind, pattern, ok in checks for m in pattern.finditer(text) if ok(m[0])]


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def simhash(text, width=3):
    w = words(ascii_lower(text or ""))
    shingles = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def simhash_components(rows, width=3, distance=3):
    prints = {i: simhash(t, width) for i, t in rows}
    return prints, components(prints, ((a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= distance))


def mix_targets(rows, most=3.0):
    """rows: (source, size). Shares by weight, stopping at the limit, until none is above."""
    sizes = {}
    for source, size in rows:
        sizes[source] = sizes.get(source, 0) + size
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, left, open_ = {}, sum(sizes.values()), set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return sizes, target


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def url_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = ascii_lower(re.match("[^/?#]*", rest)[0])
        path = re.match("[^?#]*", rest[len(host) :])[0]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def five_shingles(text, width=5):
    w = words(text)
    out = {}
    for k in range(max(1, len(w) - width + 1)):
        s = tuple(w[k : k + width])
        out[s] = out.get(s, 0) + 1
    return out


def generalised_jaccard(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


BASE = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}


def license_base(text):
    w = license_words(text)
    found = sorted((k, label) for label, phrase in BASE.items() for k in range(len(w) - len(phrase) + 1) if w[k : k + len(phrase)] == phrase)
    return len(w), found


def host_posteriors(outcomes, strength=20.0, z=1.645):
    """{host: (mean, low)} of (host, domain, suffix, bad or None) by beta-binomial priors from suffix to domain to host."""
    level = lambda at: {
        key: [sum(o[3] is not None for o in outcomes if o[at] == key), sum(o[3] or 0 for o in outcomes if o[at] == key)] for key in {o[at] for o in outcomes}
    }
    hosts, domains, suffixes = level(0), level(1), level(2)
    overall = (sum(b for _, b in hosts.values()) + 0.5) / (sum(n for n, _ in hosts.values()) + 1)

    def worth(table):
        seen = [(n, b / n) for n, b in table.values() if n > 1]
        if len(seen) < 3:
            return strength
        beyond = sum((r - overall) ** 2 - overall * (1 - overall) / n for n, r in seen) / len(seen)
        return min(100 * strength, max(1.0, overall * (1 - overall) / beyond - 1)) if beyond > 0 else 100 * strength

    s1, s2, s3 = worth(suffixes), worth(domains), worth(hosts)
    out = {}
    for host, domain, suffix in {o[:3] for o in outcomes}:
        (n1, b1), (n2, b2), (n3, b3) = suffixes[suffix], domains[domain], hosts[host]
        m1 = (b1 + s1 * overall) / (n1 + s1)
        m2 = (b2 + s2 * m1) / (n2 + s2)
        a, b = b3 + s3 * m2, n3 - b3 + s3 * (1 - m2)
        sd = (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5
        out[host] = a / (a + b), max(0.0, a / (a + b) - z * sd)
    return out


def sample_match(pattern, pick):
    """A random text that matches a pattern."""
    c = _constants

    def walk(parsed):
        out = []
        for op, arg in parsed:
            if op is c.LITERAL:
                out.append(chr(arg))
            elif op in (c.ANY, c.NOT_LITERAL) or op is c.IN and arg[0][0] is c.NEGATE:
                out.append("q")
            elif op is c.IN:
                kind, value = pick.choice(arg)
                out.append(chr(value if kind is c.LITERAL else pick.randint(*value)))
            elif op is c.BRANCH:
                out.append(walk(pick.choice(arg[1])))
            elif op is c.SUBPATTERN:
                out.append(walk(arg[-1]))
            else:
                low, high, inner = arg
                out += [walk(inner) for _ in range(pick.randint(low, min(high, low + 2)))]
        return "".join(out)

    return walk(_parser.parse(pattern))


@functools.cache  # re keeps fewer patterns than there are rules
def whole_words(pattern):
    return re.compile(f" (?:{pattern})(?= )")


def license_detections(text, rules):
    """Every rule over the joined words, then suppression within detections of the same or a higher priority: (start, end, rule)."""
    joined = " " + " ".join(license_words(text)) + " "
    hits = []
    for r in rules:
        for m in whole_words(r.pattern).finditer(joined):
            hits.append((joined.count(" ", 0, m.start()), -joined.count(" ", 0, m.end()), -r.priority, r.rule))
    kept = []
    for start, end, priority, rule in sorted(hits):
        if not any(-priority <= p and -end <= e for _, e, p, _ in kept):
            kept.append((start, -end, -priority, rule))
    return [(a, b, rule) for a, b, _, rule in kept]
