import hashlib
import os

import pytest

from cuewise.sources import file_samples


def test_fingerprints_see_sampled_bytes_sizes_and_times(spark, tmp_path):
    sizes = {"small": 10, "even": 3 * 4096, "big": 100_000}
    for name, size in sizes.items():
        (tmp_path / name).write_bytes(bytes(k % 251 for k in range(size)))
        os.utime(tmp_path / name, ns=(10 ** 18, 10 ** 18 + 7000))

    def found():
        return {r["path"].rsplit("/", 1)[-1]: (r["size"], r["fingerprint"]) for r in file_samples.fingerprints(spark, str(tmp_path), 4096).collect()}

    first = found()
    raw = (tmp_path / "big").read_bytes()
    want = hashlib.sha256(f"sampled-file-v1 100000 {10 ** 18 + 7000}".encode())
    for offset in (0, (100_000 - 4096) // 2, 100_000 - 4096):
        want.update(f" {offset} 4096 ".encode() + raw[offset:offset + 4096])
    assert first["big"] == (100_000, f"sampled-file-v1:sha256:{want.hexdigest()}")
    assert {name: size for name, (size, _) in first.items()} == sizes and found() == first
    changed = bytearray(raw)
    for place, seen in ((50_000, True), (20_000, False)):
        changed[place] ^= 1
        (tmp_path / "big").write_bytes(changed)
        os.utime(tmp_path / "big", ns=(10 ** 18, 10 ** 18 + 7000))
        now = found()
        assert (now["big"] != first["big"]) is seen and now["even"] == first["even"]
        changed[place] ^= 1
    os.utime(tmp_path / "small", ns=(10 ** 18, 10 ** 18 + 8000))
    assert found()["small"] != first["small"]
    with pytest.raises(ValueError, match="4096"):
        file_samples.fingerprints(spark, str(tmp_path), 100)
