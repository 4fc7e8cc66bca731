"""Kinds of texts, and the distance against a direct computation."""

import random

import numpy as np
import pytest

from lodeflow.llm.quality import FLOOR, distances, larger_part, not_prose, score_texts
from lodeflow.llm.stats import NAMES, measure

EN = "The editor said that the road was closed for two days, so we had to wait in the old town until the rain was over. "
ZH = "编辑说这条路已经封了两天，所以我们只好在老城里等到雨停，然后再慢慢走回去。"

CASES = [
    ("prose", EN * 3), ("prose", ZH * 3), ("prose", EN.replace(", ", ",\n").replace(" ", " ") * 2), ("prose", "- " + ("\n- ".join([EN.strip()] * 4))), ("prose", '{"title": "%s", "body": "%s"}' % (EN, EN)),
    ("list", "\n".join(f"- item number {k}" for k in range(12))), ("list", "\n".join(f"（{k}）苹果（{k * 7}）" for k in range(12))), ("list", "苹果、香蕉（3）、葡萄、西瓜、草莓（45）、橙子、樱桃、柠檬、桃子、梨、芒果、椰子"),
    ("list", "apple, banana (3), grape, melon, cherry (45), orange, lemon, peach, pear, mango, coconut, lime"), ("list", "* [ ] apple\n* [x] pear\n* [ ] plum\n* [ ] fig"),
    ("table", "| a | b | c |\n|---|---|---|\n| 1 | 2 | 3 |\n| 4 | 5 | 6 |"), ("table", "name\tage\tcity\nann\t3\tRome\nbob\t4\tOslo"), ("table", "name,age,city\nann,3,Rome\nbob,4,Oslo\ncid,5,Bern"),
    ("table", "<tr><td>a</td><td>b</td></tr>\n<tr><td>1</td><td>2</td></tr>"), ("table", "城市    人口   面积\n北京    2189   16410\n上海    2487   6340"),
    ("junk", "ha " * 40), ("junk", "哈" * 60), ("junk", r"}:@~:/||%_%;&;!?-.#}}?{\$>#{[@;;.>~+&%- ]}:#=@&}$-!~=|;_:|<*}|"), ("junk", "wskkpn ktkssxr kxqrbnqts cwdjgckkbb cdnfbmc lhfcwlpklf drq gng jwnw"),
    ("junk", "H3s/pF9JkqLYfYMXDDT9RU0nJRG/TInj8Kp6BC1U4+8GeLEOn64+oyd4YgSNmCjBlmwIKeSuQhHoufO7DX2q4E4KGqhfxF6fsUiYV3vQ"), ("junk", "首页 | 3\n登录\n12\n注册 » 4\n分享 88\n返回顶部 | 9\n下一页 2"),
    ("junk", "烫拷锟斤Ã¿½" * 20),
    ("prose", EN * 4 + "\n- apple\n- pear"), ("list", EN + "\n" + "\n".join(f"- item number {k}" for k in range(30))),
]


@pytest.mark.parametrize(("kind", "text"), CASES)
def test_kinds(kind, text):
    assert larger_part(text) == kind


def test_query(spark):
    rng = random.Random(1)
    nouns = ["road", "town", "river", "house", "garden", "market"]
    rows = [(i, " ".join(f"The {rng.choice(nouns)} near the {rng.choice(nouns)} was closed for {rng.randint(2, 99)} days, so we had to wait." for _ in range(rng.randint(2, 9)))) for i in range(300)]
    rows += [(300 + i, "".join(f"{rng.choice(['编辑', '同事', '学员'])}说这条路已经封了{rng.randint(2, 99)}天，所以我们只好在老城里等到雨停。" for _ in range(rng.randint(2, 9)))) for i in range(300)]
    rows += [(1000 + k, t) for k, (_, t) in enumerate(CASES)] + [(2000, None), (2001, ""), (2002, " \n\t"), (None, "x")]
    df = spark.createDataFrame([(*r, 1.5, "x") for r in rows], "row_id long, text string, distance double, kind string").repartition(3)
    got = {r.row_id: r.kind for r in not_prose(df).collect()}
    want = {1000 + k: kind for k, (kind, _) in enumerate(CASES) if kind != "prose"}
    assert got == want
    scored = score_texts(df).collect()
    assert len(scored) == 600 + len(CASES)
    for r in scored[:50]:
        assert r.distance == pytest.approx(sum(r.contributions), rel=1e-6, abs=1e-6) and len(r.statistics) == len(NAMES)
    assert not_prose(df.where("false")).count() == 0


def test_measure_alone_or_together():
    texts = [t for _, t in CASES] + ["", " ", "x", "é̂​"]
    together = measure(texts)[0]
    for k, t in enumerate(texts):
        assert np.allclose(together[k], measure([t])[0][0])


def test_distance():
    inverse = np.linalg.inv(np.diag(FLOOR**2))
    d, parts = distances(np.array([[1.0] * len(NAMES)]), np.zeros(len(NAMES)), inverse)
    assert d[0] == pytest.approx((1 / FLOOR**2).sum()) and parts.shape == (1, len(NAMES))
