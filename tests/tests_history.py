"""A two-atom history."""

import hashlib

from annalspark.history import History


def small_history(spark):
    status, alice = ("stated", None, []), ((b"Alice", None), (b"alice@example.com", None))
    ids = [bytes([i]) * 32 for i in (1, 2)]
    blobs = [(hashlib.sha256(b).digest(), len(b), b) for b in (b"aaa", b"bbb")]
    return History.of(
        spark, atoms=[(ids[i], i, ("git", None, b"r", ids[i]), alice, (1000 + i, 0), None, None, (m, None), status) for i, m in enumerate((b"root", b"tip"))], parents=[(ids[1], 0, ids[0])],
        ops=[(ids[0], "a b", "Add", min(blobs)[0], 0o100644, status), (ids[1], "c", "Add", max(blobs)[0], 0o100755, status), (ids[1], "a b", "Delete", None, None, status)], refs=[("main", "branch", None, ids[1], None, None, status)], blobs=blobs, provenance=[("git", "1", "1", b"r", {})],
    )
