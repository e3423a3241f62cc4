import hashlib
import re

from pyspark.sql import functions as F

from kinfold.llm import secrets
from kinfold.runtime import materialize, membership_bitmap, split_by_bitmap


def slow(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


TEXTS = [
    "", None, "token = \"" + "0123456789abcdef" * 3 + "\"", "😀é PassWord:'abcdef' api_key=abcde apikey  :  \"x=y=z/+\"", "secret: token: abcdefg", "secret=token=abcdef",
    "AKIA" + "A1" * 8 + " AKIAAKIA" + "B" * 11 + " AKIA AKIAX", "abcdef0123456789abcdef01 ABCDEF0123456789abcdef01", "a" * 10_000, "ſecret=abcdefgh toKen=abcdefgh", "password=" * 400 + "abcdef",
]


def test_against_a_plain_reading(spark):
    rows = [(i, t, "q") for i, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, blob_id string")
    found, _ = secrets.scan_documents(docs)
    line = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    want = {i: (*[sum(s[1] == k for s in slow(t or "")) for k in range(3)], hashlib.sha256(line(slow(t or "")).encode()).hexdigest(), line(slow(t or ""))) for i, t, _ in rows}
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secrets.digest(found).collect()}
    assert got == want


def test_only_unseen_pairs_are_scanned(spark):
    first = spark.createDataFrame([(1, "token=abcdefg"), (2, "-----BEGIN RSA PRIVATE KEY-----")], "doc_id long, text string")
    base = {secrets.BASE: secrets.RULES[secrets.BASE]}
    _, ledger = secrets.scan_documents(first, rules=base)
    assert {r.rule_version for r in ledger.collect()} == {secrets.BASE}
    second = spark.createDataFrame([(3, "token=abcdefg"), (4, "new secret=abcdefg"), (5, "new secret=abcdefg")], "doc_id long, text string")
    found, fresh = secrets.scan_documents(second, ledger=ledger)
    old = hashlib.sha256(b"token=abcdefg").hexdigest()
    assert sorted((r.blob_id == old, r.rule_version, r.copies) for r in fresh.collect()) == [(False, secrets.BASE, 2), (False, "provider-1", 2), (True, "provider-1", 1)]
    assert {r.doc_id: [s.kind for s in r.spans] for r in found.collect()} == {3: ["assign"], 4: ["assign"], 5: ["assign"]}


def test_ledger_that_is_kept(spark, tmp_path):
    """Three runs over growing tables: each scans what is new to it, and findings are those of a full scan."""
    path = f"file://{tmp_path}/ledger"
    for n, new in ((30, 30), (50, 20), (50, 0)):
        docs = spark.createDataFrame([(i, f"secret={'x' * 6}{i // 2}" if i % 3 else "") for i in range(n)], "doc_id long, text string")
        found, fresh = secrets.scan_documents(docs, ledger=secrets.open_ledger(spark, path))
        full, _ = secrets.scan_documents(docs)
        key = lambda rows: sorted((r.doc_id, r.blob_id, str(r.spans)) for r in rows.collect())
        assert key(found) == key(full)
        blobs = {r.blob_id for r in fresh.collect()}
        assert (len(blobs) > 0) == (new > 0) and len(blobs) <= new
        secrets.append_ledger(fresh, path)


def test_texts_of_the_ledger_are_not_shuffled(spark):
    """What moves ahead of the scan are ids and unseen texts."""
    known = [(i, f"known {i} " + "y" * 2000) for i in range(300)]
    docs = spark.createDataFrame(known + [(900, "token=abcdefgh")], "doc_id long, text string")
    _, ledger = secrets.scan_documents(docs.filter("doc_id < 900"))
    text = F.coalesce("text", F.lit(""))
    paths = docs.select("doc_id", F.sha2(text, 256).alias("blob_id"))
    todo = materialize(secrets.unseen(paths, ledger, secrets.RULES), "todo")
    assert [r.blob_id for r in todo.collect()] == [hashlib.sha256(b"token=abcdefgh").hexdigest()]
    versions = docs.select(F.sha2(text, 256).alias("blob_id"), text.alias("text"))
    maybe = split_by_bitmap(versions, membership_bitmap(todo, "blob_id"), F.col("blob_id")).filter("kf_maybe_")
    assert maybe.count() == 1
    assert secrets.scan(versions, todo, False).count() == 2


def test_very_long_text(spark):
    text = "word " * 100_000 + "token=abcdefgh " + "0123456789abcdef" * 3
    found, _ = secrets.scan_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert [(s.start, s.end, s.kind) for s in found.first().spans] == [(500_000, 500_014, "assign"), (500_015, 500_063, "hex")]


def test_added_kinds_and_empty(spark):
    docs = spark.createDataFrame([(1, "x -----BEGIN EC PRIVATE KEY----- ghp_" + "a" * 36)], "doc_id long, text string")
    found, _ = secrets.scan_documents(docs)
    assert [s.kind for s in found.first().spans] == ["pem", "forge", "hex"] or [s.kind for s in found.first().spans] == ["pem", "forge"]
    assert secrets.scan_documents(docs.limit(0))[0].collect() == []
