"""Strength with read evidence over all gaps of all reads, against a scan of every read at every site."""

import re
from collections import Counter, defaultdict

from splicelake.plans import QUERIES
from splicelake.plans.views import view

SF = "/root/testdata/sf0.001"


def stretches(pos, cigar):
    blocks, gaps = [], []
    for n, op in re.findall(r"(\d+)([MIDNSHPX=])", cigar):
        if op in "MX=":
            blocks.append((pos, pos + int(n)))
        if op == "N":
            gaps.append((pos - 1, pos + int(n) - 1))
        pos += int(n) if op in "MX=ND" else 0
    return blocks, gaps


def test_strength_counts_all_gaps_of_all_reads(spark):
    reads = defaultdict(list)
    for r in view(spark, SF, "v_read").select("sample", "region", "pos", "cigar").collect():
        reads[r.sample, r.region].append(stretches(r.pos, r.cigar))
    want = {}
    for place, own in reads.items():
        partners, alpha = defaultdict(set), Counter()
        for _, gaps in own:
            for a, b in gaps:
                partners[a].add(b)
                partners[b].add(a)
                alpha.update((a, b))
        rivals = {t: {c for p in partners[t] for c in partners[p]} - {t} for t in partners}
        beta1, beta2 = Counter(), Counter()
        for blocks, gaps in own:
            ends = {x for g in gaps for x in g}
            for t in partners:
                meets = [g for g in gaps if any(x in partners[t] and y in rivals[t] for x, y in (g, g[::-1]))]
                if any(lo <= t <= hi - 2 for lo, hi in blocks):
                    (beta2 if ends & partners[t] and meets else beta1)[t] += 1
                if any(a < t < b for a, b in gaps) and not any(g[0] < t for g in meets):
                    beta2[t] += 1
        want |= {(*place, t): (alpha[t], beta1[t], beta2[t]) for t in partners}
    got = {(r.sample, r.region, r.site): (r.alpha, r.beta1, r.beta2) for r in QUERIES["strength_with_cryptic"](spark, SF).collect()}
    assert got == want
