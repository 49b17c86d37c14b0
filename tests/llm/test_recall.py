"""Near-duplicates against an exact join: all pairs by prefixes of the rarest shingles, in plain Python.

RECALL_SF_DIR names the tables (default: sf0.001); `python -m tests.llm.test_recall` prints the figures."""

import os
import re
from collections import Counter, defaultdict

import pytest

from quillon.llm.minhash import keep_first, near_duplicates

SF_DIR = os.environ.get("RECALL_SF_DIR", "/root/testdata/sf0.001")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))) if words else frozenset()


def exact(texts: dict[int, str], n: int, percent: int = 80) -> tuple[set[tuple[int, int]], dict[int, int]]:
    """All linked pairs, and each document's component. Two sets that are similar enough share one of the
    first |s| - ceil(percent * |s| / 100) + 1 shingles of either, the rarest first."""
    sets = {k: shingles(t, n) for k, t in texts.items()}
    often = Counter(s for x in sets.values() for s in x)
    name = {s: i for i, s in enumerate(sorted(often, key=lambda s: (often[s], s)))}
    ids = {k: frozenset(name[s] for s in x) for k, x in sets.items()}
    posted, links = defaultdict(list), set()
    for k in sorted(ids, key=lambda k: (len(ids[k]), k)):
        mine = ids[k]
        prefix = sorted(mine)[: len(mine) - -(-percent * len(mine) // 100) + 1] if mine else []
        seen = {x for s in prefix for x in posted[s]}
        for x in seen:
            other = ids[x]
            if 100 * len(other) >= percent * len(mine):
                both = len(mine & other)
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    links.add((min(x, k), max(x, k)))
        for s in prefix:
            posted[s].append(k)
    root = {k: k for k in texts}

    def top(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in sorted(links):
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return links, {k: top(k) for k in texts}


def recall(spark, sf_dir: str) -> dict[str, float]:
    """The share of exactly linked pairs whose documents are together, for the registered query (two words),
    and of documents with a smaller one linked that go, for the pipeline's stage (five); with counts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    out = {}
    for n, shingle in (("query", 2), ("stage", 5)):
        links, component = exact(texts, shingle)
        if n == "query":
            got = {r.doc_id: r.component_id for r in near_duplicates(docs, shingle=2, percent=80).collect()}
            found, wrong = sum(got[a] == got[b] for a, b in links), sum(got[k] != component[k] for k in texts)
        else:
            kept = {r.doc_id for r in keep_first(docs).select("doc_id").collect()}
            gone = {k for k in texts if component[k] != k}
            found, wrong, links = len(gone - kept), len(kept ^ (set(texts) - gone)), gone
        out |= {f"{n}_wanted": len(links), f"{n}_recall": found / max(len(links), 1), f"{n}_wrong_documents": wrong}
    return out


@pytest.fixture(scope="module")
def found(spark):
    return recall(spark, SF_DIR)


def test_every_link_is_found(found):
    assert found["query_recall"] == found["stage_recall"] == 1 and found["query_wanted"] > 0 and found["stage_wanted"] > 0


def test_no_document_is_in_a_wrong_group(found):
    assert found["query_wrong_documents"] == found["stage_wrong_documents"] == 0


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "16").getOrCreate()
    print(recall(session, SF_DIR))
