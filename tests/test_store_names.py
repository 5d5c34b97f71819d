"""Names of files in Mercurial stores, and a store whose names are hashed."""

import pytest

from annalspark.sources import revlog

from test_sources import make_revlog

# Examples of the format's public description.
NAMES = {
    "data/AUX/SECOND/X.PRN/FOURTH/FI:FTH/SIXTH/SEVENTH/EIGHTH/NINETH/TENTH/ELEVENTH/LOREMIPSUM.TXT.i": "dh/au~78/second/x.prn/fourth/fi~3afth/sixth/seventh/eighth/nineth/tenth/loremia20419e358ddff1bf8751e38288aff1d7c32ec05.i",
    "data/enterprise/openesbaddons/contrib-imola/corba-bc/netbeansplugin/wsdlExtension/src/main/java/META-INF/services/org.netbeans.modules.xml.wsdl.bindingsupport.spi.ExtensibilityElementTemplateProvider.i": "dh/enterpri/openesba/contrib-/corba-bc/netbeans/wsdlexte/src/main/java/org.net7018f27961fdf338a598a40c4683429e7ffb9743.i",
    "data/AUX.THE-QUICK-BROWN-FOX-JU:MPS-OVER-THE-LAZY-DOG-THE-QUICK-BROWN-FOX-JUMPS-OVER-THE-LAZY-DOG.TXT.i": "dh/au~78.the-quick-brown-fox-ju~3amps-over-the-lazy-dog-the-quick-brown-fox-jud4dcadd033000ab2b26eb66bae1906bcb15d4a70.i",
    "data/Project Planning/Resources/AnotherLongDirectoryName/Followedbyanother/AndAnother/AndThenAnExtremelyLongFileName.txt": "dh/project_/resource/anotherl/followed/andanoth/andthenanextremelylongfilenaf93030515d9849cfdca52937c2204d19f83913e5.txt",
    "data/foo.i/bar.d/bla.hg/hi:world?/HELLO.i": "data/foo.i.hg/bar.d.hg/bla.hg.hg/hi~3aworld~3f/_h_e_l_l_o.i",
    "data/com1com2/lpt9.lpt4.lpt1/conprn/foo./_a .i": "data/com1com2/lp~749.lpt4.lpt1/conprn/foo~2e/__a .i",
    "data/.a/ b/c..i": "data/~2ea/~20b/c..i",
}


@pytest.mark.parametrize("entry", NAMES)
def test_names_of_the_public_description(entry):
    assert revlog.store_name(entry) == NAMES[entry]


def test_hashed_names_are_bounded_and_tell_files_apart():
    long = ["d" * 30 + f"/{k}/" + "e" * 200 for k in range(50)] + ["f/" * 100 + f"{k}.txt" for k in range(50)] + ["日本" * 40 + str(k) for k in range(20)]
    names = [revlog.store_path(p) for p in long]
    assert len(set(names)) == len(long) and all(n.startswith("dh/") and len(n) <= revlog.LONGEST and n.endswith(".i") for n in names)


def test_a_store_with_hashed_names(spark, tmp_path):
    long = "some/folder/with/" + "a-very-long-name-" * 10 + ".txt"
    index, nodes = make_revlog([b"hello", b"hello again"])[0], make_revlog([b"hello", b"hello again"])[2]
    for name in (revlog.store_path(long), revlog.store_path("short")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(index)
    (tmp_path / "fncache").write_text(f"data/{long}.i\ndata/{long}.d\ndata/short.i\n")
    rows = revlog.read(spark, str(tmp_path))["file_revisions"].collect()
    assert sorted({r["name"].removeprefix(str(tmp_path)).lstrip("/") for r in rows}) == sorted((f"data/{long}", "data/short"))
    assert sorted(bytes(r["text"]) for r in rows) == [b"hello", b"hello", b"hello again", b"hello again"] and {bytes(r["node"]) for r in rows} == set(nodes)
