"""The whole pipeline against a plain version of its stages."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import tiktoken
import xxhash

import corpus_pipeline as P
from lodestone.llm import bpe

WORDS = "sun moon river stone tree cloud grass bird fish hill road lamp glass paper winter summer".split()
SPACE = r"[\x20\x09-\x0D]"


def corpus():
    """Half a hundred long texts with copies and near copies, some toxic, some with personal data, in four sources."""
    rng = random.Random(11)
    rows = []
    for i in range(60):
        text = " ".join(rng.choices(WORDS, k=rng.randint(200, 400)))
        text += f" write to user{i}@mail.example.org" * (i % 5 == 0) + f" or call +49 170 12345{i:02d}\tnow" * (i % 7 == 0)
        rows.append((text, ["a", "b", "c", None][i % 4], 0))
        if i % 6 == 0:
            rows += [(text, "b", 0), (text.upper().lower().replace("\t", " "), "a", 0), (text + " extra", "c", 0)]
        if i % 3 == 0:
            rows.append((" ".join(rng.choices(WORDS, k=30)) + " you moron, you idiot", "a", 1))
    rng.shuffle(rows)
    return [(n, text, "en", source, len(text)) for n, (text, source, _) in enumerate(rows)], [(n, 1, toxic) for n, (_, _, toxic) in enumerate(rows)]


def print_of(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower())
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_distinct(rows):
    prints, root = [print_of(r[1]) for r in rows], list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    return [rows[i] for i in sorted({min((k for k in range(len(rows)) if root[k] == root[i]), key=lambda k: rows[k][0]) for i in range(len(rows))})]


def plain_mask(text):
    text = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "[EMAIL]", text)
    return re.sub(r"\+[0-9][ ().0-9-]+[0-9]", "[PHONE]", text)


def plain_mix(rows):
    size = lambda r: len(re.findall(rf"[^{SPACE[1:]}+", r[1]))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    weight, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}, {s: sum(size(r) for r in rows if r[3] == s) for s in sources}
    target, free, rest = {}, set(sources), 1.5 * sum(total.values())
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * total[s]]
        for s in over or list(free):
            target[s] = 2.0 * total[s] if over else share[s]
            free.discard(s)
        rest -= sum(target[s] for s in over)
    out = []
    for s in sources:
        budget = int(target[s] + 0.5)
        epochs, left = divmod(budget, total[s])
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: (hashlib.md5(f"10:{r[0]}".encode()).hexdigest()[:13], r[0])):
            n = size(r)
            whole, part = epochs, min(n, max(0, left))
            left -= part
            whole, part = (whole + 1, 0) if part == n else (whole, part)
            out += [r] * whole
            if part:
                out.append((r[0], re.match(rf"(?:{SPACE}*[^{SPACE[1:]}+){{{part}}}", r[1])[0], *r[2:]))
    return out


def test_pipeline_against_a_plain_version(spark, tmp_path):
    docs, labels = corpus()
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    toxic = {i for i, _, t in labels if t}
    rows = plain_distinct([r for r in docs if r[0] not in toxic])
    assert len(rows) < len(docs) - len(toxic)
    rows = plain_mix([(r[0], plain_mask(r[1]), *r[2:]) for r in rows])
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter((r[0], r[3], tuple(encoding.encode_ordinary(r[1]))) for r in rows)
    got = P.run(spark, d).collect()
    assert all(r.decoded_ok and r.n_tokens == len(r.ids) for r in got)
    assert Counter((r.doc_id, r.source, tuple(r.ids)) for r in got) == want
