"""Cases in which a bound or a narrow shape once stood for the whole job."""

import collections
import math
from zlib import crc32

from pagetrove.llm import lm_scoring, secrets
from pagetrove.llm.common import documents

from .conftest import frame


def test_lm_scores_all_ngrams(spark, sf_small):
    """Plain Python with every pair and triple seen 3 times, whatever its share; large shares leave all to the join."""
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in documents(spark, sf_small).collect()}
    c = collections.Counter()
    for i, ws in texts.items():
        if crc32(str(i).encode()) % 5 != 1:
            ws = [b"", *ws, b""]
            for k in (1, 2, 3):
                c.update(tuple(ws[j:j + k]) for j in range(k == 1, len(ws) - k + 1))
    ones = {g: x for g, x in c.items() if len(g) == 1}
    n, v, d = sum(ones.values()), len(ones), 0.75
    n1, n2 = (sum(x == k for x in ones.values()) for k in (1, 2))
    rest = min(0.9, max(0.1, n1 / (n1 + 2 * n2)))
    after = collections.defaultdict(list)
    for g, x in c.items():
        if len(g) > 1 and x >= 3:
            after[g[:-1]].append(g)
    back = {}

    def p(g):
        if len(g) == 1:
            return (c[g] - rest) / n if g in ones else rest * v / n
        if c[g] >= 3:
            return (c[g] - d) / c[g[:-1]]
        return back.get(g[:-1], 1.0) * p(g[1:])

    for h in sorted(after, key=len):
        back[h] = max(1 - sum(p(g) for g in after[h]), 1e-9) / max(1 - sum(p(g[1:]) for g in after[h]), 1e-9)
    want = {}
    for i, ws in texts.items():
        ws = [b"", *ws, b""]
        want[i] = sum(math.log10(p(tuple(ws[max(0, j - 2):j + 1]))) for j in range(1, len(ws)))
    for config in (lm_scoring.LmConfig(), lm_scoring.LmConfig(arc_share=0.5, root_share=0.5), lm_scoring.LmConfig(arc_share=1e-3, root_share=1e-3)):
        got = {r.doc_id: r.score for r in lm_scoring.score(documents(spark, sf_small), config=config).collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[i], want[i], rel_tol=1e-6, abs_tol=1e-6) for i in want), config


def test_ordinary_runs_are_no_secrets(spark, sf_small):
    plain = ["=" * 20, "-" * 20, "/2023/01/15/article-about-things", "some/path/to/file/in/tree", "user_profile_2023_backup_01",
             "getUserAccountByIdentifier", "MAXIMUM_CONNECTION_POOL_SIZE", "src/main/java/HttpServer2Test"]
    random = ["ghp_16C7e42F292c6912E7710c838347Ae178B4a", "dGhpcyBpcyBhIHNlY3JldCBrZXkgYnl0ZXM3", "MZ8Q2XK7R4V9T1B6N3P5",
              "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "7Hq9ZtLp3XvBn5Rk"]
    docs = frame(spark, [(i, f"see {s} here", "en", "a") for i, s in enumerate(plain + random)])
    model = secrets.fit(secrets.samples(documents(spark, sf_small)))
    got = {r.doc_id: r.text for r in secrets.redact(docs, model).collect()}
    assert [got[i] for i in range(len(plain))] == [f"see {s} here" for s in plain]
    assert all(got[len(plain) + i] == "see [SECRET] here" for i in range(len(random)))
