"""Workers without this package on their path, as on a cluster that was given the driver's code alone."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from quarryline.session import build_session
from quarryline.llm import huffman, langid, linededup, minhash, queries, secrets, simhash, toxicity, winnow
spark = build_session(cores="2", partitions=2, app="far")
for name in ("op5_toxicity", "op6_langid", "op8_secrets", "op9_line_dedup", "op10_winnow", "op11_divergence", "op12_simhash", "op13_repair"):
    print(name, queries.QUERIES[name](spark, {sf!r}).count())
    assert not spark.range(1).mapInArrow(lambda batches: (b for b in batches), "id long").isEmpty()
print("all ran")
"""


def test_operators_run_from_another_folder(sf_dir, tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    if others := [p for p in os.environ.get("PYTHONPATH", "").split(":") if p and os.path.realpath(p) != os.path.realpath(repo)]:
        env["PYTHONPATH"] = ":".join(others)
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo, sf=sf_dir)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all ran" in done.stdout, done.stdout[-500:] + done.stderr[-3000:]
