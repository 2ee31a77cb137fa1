import json
import random

import pytest

from packwright.operators import samples as S
from packwright.sources import pairs, sinks


def line(idx, **more):
    base = {
        "idx": idx, "cve": f"CVE-{idx}", "cwe": [f"CWE-{idx % 3}"] if idx % 4 else [], "project": f"p{idx % 2}", "project_url": "u", "file_name": "a.c", "vulnerable_commit_id": "v" * 20,
        "vulnerability_introducing_commit_id": "i" * 20, "vulnerability_fixing_commit_id": "f" * 20, "vulnerable_function_body": f"c\nint f{idx}(void) {{}} ", "non_vulnerable_function_body": "int g(void) {}",
    }
    return base | more


def write(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_scan_dedup_explode(spark, tmp_path):
    path = write(tmp_path / "pairs.jsonl", [line(1), line(2), line(1, vulnerable_function_body="other"), line(3)])
    rows = S.load_samples(pairs.scan_pairs(spark, path)).orderBy("ord", "half").collect()
    assert [r.sample_id for r in rows] == ["1-vuln", "1-benign", "2-vuln", "2-benign", "3-vuln", "3-benign"]
    assert rows[0].func_body == "int f1(void) {}" and rows[0].label == 1 and rows[0].commit == "v" * 20 and rows[0].worktree == "p1-" + "v" * 12
    assert S.load_samples(pairs.scan_pairs(spark, path, True), "vul-intro").where("half = 0").first().commit == "i" * 20


@pytest.mark.parametrize("bad", ["\n", "{oops\n", json.dumps({"idx": 9}) + "\n"])
def test_bad_lines_fail(spark, tmp_path, bad):
    path = tmp_path / "pairs.jsonl"
    path.write_text(json.dumps(line(1)) + "\n" + bad)
    with pytest.raises(Exception):  # noqa: B017
        pairs.scan_pairs(spark, str(path)).collect()


def direct_draw(sizes, n, seed):
    rng = random.Random(seed)
    order = list(range(len(sizes)))
    rng.shuffle(order)
    left = {s: list(range(sizes[s])) for s in range(len(sizes))}
    for s in order:
        rng.shuffle(left[s])
    out = []
    while len(out) < n and any(left.values()):
        for s in order:
            if left[s] and len(out) < n:
                out.append((s, left[s].pop()))
    return out


def test_round_robin_is_the_direct_loop():
    rng = random.Random(5)
    for _ in range(100):
        sizes = [rng.randint(1, 6) for _ in range(rng.randint(1, 8))]
        n, seed = rng.randint(0, 20), rng.randint(0, 9)
        assert S.round_robin_order(sizes, n, seed) == direct_draw(sizes, n, seed)


def test_draw_keeps_pairs_whole(spark, tmp_path):
    path = write(tmp_path / "pairs.jsonl", [line(i) for i in range(20)])
    got = S.stratified_draw(S.load_samples(pairs.scan_pairs(spark, path)), 6, 3).collect()
    assert len(got) == 12 and len({r.pair_id for r in got}) == 6 and sorted({r.pos for r in got}) == list(range(6))


def test_frozen_sets(spark, tmp_path):
    path = write(tmp_path / "pairs.jsonl", [line(i) for i in range(5)])
    frozen = str(tmp_path / "x" / "set.json")
    ids = ["3-vuln", "1-benign", "3-vuln"]
    saved = sinks.save_frozen(frozen, ids, 0, path)
    assert sinks.load_frozen(frozen, path) == saved and saved["n_samples"] == 3
    assert saved["dataset_hash"] == pairs.dataset_hash(spark, path)
    samples = S.load_samples(pairs.scan_pairs(spark, path))
    assert [r.sample_id for r in S.apply_frozen(samples, ids).orderBy("pos").collect()] == ids
    with pytest.raises(ValueError, match="9-vuln"):
        S.apply_frozen(samples, ["9-vuln"])
    write(tmp_path / "pairs.jsonl", [line(7)])
    with pytest.raises(ValueError):
        sinks.load_frozen(frozen, path)


def test_limits(spark, tmp_path):
    path = write(tmp_path / "pairs.jsonl", [line(i) for i in range(3)])
    samples = S.load_samples(pairs.scan_pairs(spark, path))
    assert [r.sample_id for r in S.limit_samples(samples, 3).collect()] == ["0-vuln", "0-benign", "1-vuln"]
    assert S.limit_samples(samples, -2).count() == 4
