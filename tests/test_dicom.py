import struct

import pytest

from radveil.functions import fixed as X
from radveil.plans import pipeline
from radveil.sources import dicom as D

N = X.TAG_NUMBERS
SYNTAXES = ["1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99"]


def sample(syntax="1.2.840.10008.1.2.1", pid="A1", day="20240112", raw=False):
    e = lambda k, vr, v: D.Element(N[k], vr, v.encode())
    inner = [D.Element(0x00080090, "PN", b"Nested^Name"), D.Element(0x00091001, "LO", b"private ^"), D.Element(0x00081155, "UI", b"1.2.9")]
    body = [e("ImageType", "CS", "ORIGINAL\\PRIMARY"), e("SOPInstanceUID", "UI", "1.2.3"), e("StudyDate", "DA", day), e("ContentDate", "DA", "2024"), e("AccessionNumber", "SH", "ACC"), e("Modality", "CS", "CT"), e("ReferringPhysicianName", "PN", "Doc^Tor"), D.Element(0x00081110, "SQ", [inner, []]), D.Element(0x00091001, "LO", b"secret"), e("PatientName", "PN", "Rahima"), e("PatientID", "LO", pid), e("PatientAge", "AS", "093Y"), e("StudyInstanceUID", "UI", "1.2"), D.Element(0x00280010, "US", struct.pack((">" if syntax == D.BIG else "<") + "H", 512)), e("RequestingPhysician", "PN", "Some One")]
    fragments = b"".join(struct.pack("<HHI", 0xFFFE, t, len(v)) + v for t, v in ((0xE000, b""), (0xE000, b"jpegdata"), (0xE0DD, b"")))
    body.append(D.Element(D.PIXELS, "OB", fragments, True) if raw else D.Element(D.PIXELS, "OW", bytes(range(16))))
    head = [D.Element(D.MEDIA_UID, "UI", b"1.2.3"), D.Element(D.SYNTAX, "UI", syntax.encode())]
    return D.write(syntax, head, body)


@pytest.mark.parametrize("syntax", SYNTAXES)
def test_files_are_read_and_rewritten(syntax):
    data = sample(syntax)
    t = D.tags(data)
    assert (t["PatientID"], t["StudyDate"], t["(0008,1110)[0].ReferringPhysicianName"]) == ("A1", "20240112", "Nested^Name")
    assert D.write(*D.read(data)) == data
    out = D.deidentified(data, "RP-1", 3, lambda u: "2.25." + u.replace(".", ""))
    t = D.tags(out)
    assert "Name" not in "".join(k for k in t if k != "PatientName") and not any(w in v for v in t.values() for w in ("private ^", "secret", "Some", "Nested", "Tor"))
    assert (t["PatientName"], t["PatientID"], t["PatientAge"], t["StudyDate"], t["ContentDate"], t["SOPInstanceUID"], t["StudyInstanceUID"], t["PatientIdentityRemoved"]) == ("RP-1", "RP-1", "090Y", "20240115", "2024", "2.25.123", "2.25.12", "YES")
    assert "AccessionNumber" not in t and t["(0008,1110)[0].(0008,1155)"] == "1.2.9"
    syntax_, head, body = D.read(out)
    assert syntax_ == syntax and {e.tag: e.value for e in head}[D.MEDIA_UID].startswith(b"2.25.123") and body[-1].value == bytes(range(16))


def test_encapsulated_pixels_and_broken_files():
    data = sample(raw=True)
    assert D.write(*D.read(data)) == data and b"jpegdata" in D.deidentified(data, "R", 1, str)
    for bad in (b"", b"x" * 500, data[:150], data[:200]):
        assert D.tags(bad) is None or bad == data[:200]
    assert D.tags(data[:400]) is None or isinstance(D.tags(data[:400]), dict)


def test_folder(spark, tmp_path):
    folder, secure = tmp_path / "in", tmp_path / "s"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.dcm").write_bytes(sample())
    (folder / "deep" / "b").write_bytes(sample(pid="B9"))
    (folder / "c.txt").write_text("no image")
    assert {r.file.rsplit("/", 1)[1] for r in D.read_headers(spark, str(folder)).collect()} == {"a.dcm", "b"}
    cfg = pipeline.Config(tmp_path / "raw", secure, tmp_path / "out", tmp_path / "k" / "k")
    vault = pipeline.Vault(secure, cfg.key_file)
    vault.save("identity_map", spark.createDataFrame([("u1", "", "a 1".upper(), "n", "F", "", "2024-01-10", "", "", "RP-1", "r", "e")], pipeline.STATE["identity_map"]))
    vault.save("date_shifts", spark.createDataFrame([("RP-1", 3)], pipeline.STATE["date_shifts"]))
    got = pipeline.dicom_folder(spark, cfg, str(folder), str(tmp_path / "img"))
    (row,) = got["manifest"].collect()
    assert row.output.startswith(str(tmp_path / "img" / "RP-1")) and row.report_uid == "u1"
    made = D.tags(open(row.output, "rb").read())
    assert made["StudyInstanceUID"] == row.study_id and made["PatientID"] == "RP-1"
    assert [r.file.rsplit("/", 1)[1] for r in got["unlinked"].collect()] == ["b"]
    assert pipeline._load(vault, spark, "image_links").collect()[0].study_id == row.study_id
