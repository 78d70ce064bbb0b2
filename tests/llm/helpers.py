"""Rows that operators must live with, and a check of unchanged neighbours."""

import hashlib
import re

from pyspark.sql import functions as F

WORDS = "the of and ingtion erther onand wherof thesting anlyre houtin".split()


def prose(n: int, seed: int = 1) -> str:
    out, x = [], seed
    for i in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x % len(WORDS)] + ("" if x % 3 else str(x % 97)))
        if i % 12 == 11:
            out[-1] += ".\n"
    return " ".join(out)


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, one id with two texts, and
    columns named like operators' own."""
    long = prose(30_000, 9)
    rows = [
        (1, prose(120, 1), "en", "a", 5), (2, prose(120, 1), "en", "a", 5), (2, prose(120, 1), "en", "a", 5), (3, None, None, None, None), (None, prose(80, 2), "de", "b", 1),
        (None, None, None, None, None), (4, "", "en", "", 0), (5, " \n\t\r\x0b\x0c ", "en", "a", 2), (6, long, "en", "a", 7), (7, "ein einziges Wort ä", "de", None, 3), (7, "zwei Texte", "de", "b", 3),
        (8, "\n\n\n", "en", "b", 3), (9, "12 34 !!", "en", "b", 8), (10, "日本語 текст mixed ünïcode 😀 words here and there", "en", "c", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ("n_words", "score", "size", "taken", "items", "d", "t", "key", "spans", "base", "found", "kept", "prefix", "component", "cid", "doc", "label", "n", "_m1", "rank", "copies", "target", "n_lines", "host")
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in clash])


def empty(spark):
    return awkward(spark).where("false")


def plain_lines(texts):
    """Line dedup done by pairs of adjacent lines with a word, document by document."""
    seen, out = set(), {}
    for key in sorted(texts):
        if texts[key] is None:
            out[key] = None
            continue
        lines = texts[key].encode().split(b"\n")
        full = [i for i, x in enumerate(lines) if x.strip()]
        units = [(full[0], full[0])] if len(full) == 1 else list(zip(full, full[1:]))
        gone = set()
        for a, b in units:
            content = b"\n".join(lines[a : b + 1])
            if content in seen:
                gone.update(range(a, b + 1))
            seen.add(content)
        for i, x in enumerate(lines):
            if not x.strip() and (i - 1 in gone or not any(j < i for j in full) and full and full[0] in gone):
                gone.add(i)
        ends = [b"\n"] * (len(lines) - 1) + [b""]
        out[key] = b"".join(x + e for i, (x, e) in enumerate(zip(lines, ends)) if i not in gone).decode()
    return out


#: Names that operators use inside, all of them as columns of a caller.
INNER = (
    "d t s e h1 h2 cs ce c1 c2 head row text_ cut want x parts bytes kept is_first first n g key open large at size lo w content id spans lists doc prefix n_hot cid label gid list c c0 c1 c2 "
    "host path html rule rules verdict parent src dst pages share score kind mass _rules _best _m _l _row _x _k _w _f _d _t _cut _text _lost lang i l k drawn bucket run offset bin finish skey source_size "
    "target taken copies twin other own_doc_id own_source own_size placed n_words n_hit items hit_bits r often base found m a b p u v number tokens counts token"
).split()


def clashing(df):
    """Every inner name that ``df`` doesn't have as a column of text."""
    have = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in dict.fromkeys(INNER) if c not in have])


def plain_mix(rows):
    """Targets by repeated resharing, order by finish time."""
    size = {}
    for _, s, n in rows:
        size[s] = size.get(s, 0) + n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, full = sum(size.values()), {}, set()
    while True:
        rest = total - sum(3 * size[s] for s in full)
        w = sum(weight[s] for s in order if s not in full)
        target = {s: 3 * size[s] if s in full else rest * weight[s] / w for s in order}
        over = {s for s in order if s not in full and target[s] >= 3 * size[s]}
        if not over:
            break
        full |= over
    copies = []
    for s in order:
        done = 0
        own = sorted((hashlib.md5(str(d).encode()).hexdigest(), d, n) for d, t, n in rows if t == s)
        for h, d, n in own:
            done += n
            if n:
                copies += [((e * size[s] + done) / target[s], s is not None, s or "", h, d, n) for e in range(3)]
    taken, spent = dict.fromkeys((d for d, _, _ in rows), 0), 0
    for _, _, _, _, d, n in sorted(copies):
        if spent + n > total:
            break
        spent += n
        taken[d] += n
    return size, target, taken


_WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_clean(text, items, n=10, most=0.5):
    """The text without words inside windows of the items, and what stands between two such words; None if
    more than ``most`` of its words go."""
    raw = text.encode()
    spans = [m.span() for m in re.finditer(_WORD, raw.lower())]
    words = [raw[s:e].lower() for s, e in spans]
    hit = set()
    for item in items:
        own = re.findall(_WORD, (item or "").encode().lower())
        windows = {tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1))} if own else set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in windows:
                    hit.update(range(i, i + size))
    if len(hit) > most * len(words):
        return None
    gone = bytearray(len(raw))
    for i in hit:
        s, e = spans[i][0], spans[i + 1][0] if i + 1 in hit else spans[i][1]
        gone[s:e] = b"\1" * (e - s)
    return bytes(x for x, g in zip(raw, gone) if not g).decode()
