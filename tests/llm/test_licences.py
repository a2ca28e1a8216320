"""Licence scans by canonical digest."""

from wardframe.llm import licences
from wardframe.llm.licence_texts import LICENCES, NOTICES

from . import cases


def test_whole_texts_and_notices(spark):
    plain = dict(reversed(LICENCES))
    mit, bsd = plain["MIT"], plain["BSD-2-Clause"]
    texts = [(1, mit.upper()), (2, "Copyright (c) 2020 A. Person\n\n" + mit.replace("\n", "  \n")),
             (3, bsd.replace('"AS IS"', "'as is'")), (4, mit + " and more"),
             (5, mit.replace("sublicense", "sublicence")), (6, "words\n" + NOTICES[0][1] + "\n"
              "\nThis work is licenced under the GNU general public licence, version 3"),
             (7, None), (8, ""), (None, mit), (1, mit.upper()),
             (9, "© someone, all rights\n" + plain["ISC"])]
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.license, r.notices)
                 for r in licences.scan_licences(cases.documents(spark, texts)).collect()
                 if r.doc_id != 4)
    assert got == [(-1, "MIT", ""), (1, "MIT", ""), (1, "MIT", ""), (2, "MIT", ""),
                   (3, "BSD-2-Clause", ""), (5, "MIT", ""), (6, None, "GPL-3.0,MIT"),
                   (7, None, ""), (8, None, ""), (9, "ISC", "")]
    rows = licences.scan_licences(cases.documents(spark)).collect()
    assert cases.ids(rows) == cases.ALL_IDS and not any(r.license for r in rows)
    assert licences.scan_licences(cases.empty(spark)).count() == 0


def test_titles_and_notice_lines(spark):
    plain = dict(reversed(LICENCES))
    mit, bsd = plain["MIT"], plain["BSD-3-Clause"]
    wrapped = mit.replace("The above copyright notice", "The above\ncopyright notice")
    texts = [(1, "The MIT License (MIT)\n\nCopyright (c) 2011 Some One\n\n" + mit),
             (2, "BSD 3-Clause License\nCopyright 2003, A, B\nAll rights reserved.\n" + bsd),
             (3, wrapped), (4, "copyright is a right of authors\n" + mit),
             (5, "(c) 1999 A\n(C) Copyright B\nCopyright by C\n" + mit), (6, "(c) keep this\n" + mit),
             (7, plain["Unlicense"])]
    got = {r.doc_id: r.license for r in licences.scan_licences(cases.documents(spark, texts)).collect()}
    assert got == {1: "MIT", 2: "BSD-3-Clause", 3: "MIT", 4: None, 5: "MIT", 6: None,
                   7: "Unlicense"}


def test_licences_of_a_folder(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("Own License\nCopyright (c) 2020 X\n\nUse it\nwell.\n")
    (tmp_path / "Other").write_text("Do not use it.")
    known = licences.licence_files(spark, str(tmp_path))
    texts = [(1, "OWN LICENCE - use it, well"), (2, "do not use it"), (3, "use it")]
    got = {r.doc_id: r.license for r in licences.scan_licences(
        cases.documents(spark, texts), known).collect()}
    assert got == {1: "Own-1.0", 2: "Other", 3: None}
