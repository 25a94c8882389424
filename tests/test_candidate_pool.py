"""The candidate pool against the rules, row by row."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from curatrix.operators import dedup, sampling

SCHEMA = "id string, reason string, score double, page string, template string, tertile int, bits long"


def brute(rows, target, mix, seed):
    order = lambda r: (-r[2], hashlib.md5(f"{seed}|{r[0]}".encode()).hexdigest())
    by = defaultdict(list)
    for r in sorted((r for r in rows if r[1] is not None), key=order):
        by[r[1]].append(r)
    pages, templates, tertiles, hashes, out = Counter(), Counter(), Counter(), defaultdict(list), []

    def accept(r, tertile, cap):
        i, why, _, page, template, c, b = r
        if r in out or (tertile and tertiles[why, c] >= tertile) or (page and pages[why, page] >= cap) or templates[why, template] >= max(4, int(0.35 * target)):
            return False
        if b is not None:
            if any(((b ^ o) & (2**64 - 1)).bit_count() <= 4 for o in hashes[why]):
                return False
            hashes[why].append(b)
        pages[why, page] += 1
        templates[why, template] += 1
        tertiles[why, c] += 1
        out.append(r)
        return True

    got = Counter()
    for why, share in mix.items():
        n = round(share * target)
        kinds = len({r[3] for r in by[why]})
        cap = max(2, min(8, -(-n // kinds))) if kinds else 2
        for r in by[why][: max(3 * n, 20)]:
            if got[why] >= n:
                break
            got[why] += accept(r, max(1, n // 3), cap)
    for why, share in mix.items():
        n = round(share * target)
        for r in by[why]:
            if got[why] >= int(n * 1.25) + 2 or len(out) >= target:
                break
            got[why] += accept(r, max(1, n // 2), 8)
    for r in sorted((r for v in by.values() for r in v), key=order):
        if len(out) >= target:
            break
        accept(r, 0, 16)
    return [(r[0], r[1], i) for i, r in enumerate(out, 1)]


def pool(spark, rows, target, mix, depth=64):
    d = sampling.candidate_pool(spark.createDataFrame(rows, SCHEMA), target, mix, 3, "id", "reason", "score", "page", "template", "tertile", "bits", depth)
    return sorted((tuple(r) for r in d.collect()), key=lambda r: r[2])


@pytest.mark.parametrize("pages,depth,near", [(30, 64, 0.5), (3, 1, 0.9), (1, 2, 0.2)])
def test_pool_against_brute_force(spark, pages, depth, near):
    rng = random.Random(pages)
    centers = [rng.getrandbits(64) - 2**63 for _ in range(12)]

    def bits():
        if rng.random() < 0.1:
            return None
        b = rng.choice(centers) if rng.random() < near else rng.getrandbits(64) - 2**63
        for _ in range(rng.randint(0, 4)):
            b ^= 1 << rng.randrange(63)
        return b

    rows = [(f"s{i}", rng.choice(["a", "a", "a", "b", "c", "other", None]), round(rng.random(), 1), rng.choice([f"p{rng.randrange(pages)}"] * 9 + [""]), f"t{rng.randrange(4)}", rng.randrange(3), bits()) for i in range(400)]
    mix = {"a": 0.5, "b": 0.3, "c": 0.1, "none": 0.1}
    got = pool(spark, rows, 60, mix, depth)
    assert got == brute(rows, 60, mix, 3) and got


def test_near_copies_go_and_a_short_reason_is_filled(spark):
    far = lambda i: (i * 0x9E3779B97F4A7C15 & (2**64 - 1)) - 2**63
    rows = [(f"n{i}", "short", 1.0, f"p{i}", f"t{i % 9}", i % 3, far(1) ^ (1 << i)) for i in range(9)] + [(f"m{i}", "much", 0.5, f"p{i}", f"t{i % 9}", i % 3, far(i + 50)) for i in range(90)]
    got = pool(spark, rows, 30, {"short": 0.5, "much": 0.5})
    assert len(got) == 30 and Counter(r[1] for r in got) == {"short": 1, "much": 29}


def test_text_hash():
    text = " ".join(f"word{i}" for i in range(400))
    apart = lambda a, b: ((dedup.text_hash(a) ^ dedup.text_hash(b)) & (2**64 - 1)).bit_count()
    assert dedup.text_hash("") is None and dedup.text_hash(None) is None
    assert apart(text, text.upper()) == 0 and apart(text, text + " tail") <= 4 < apart(text, text.replace("word", "other"))
