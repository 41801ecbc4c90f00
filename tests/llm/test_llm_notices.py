"""Standard file notices of the GPL."""

from quirelake.llm.license_scan import scan_licences

NOTICE = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU {name}General Public License as published by
# the Free Software Foundation{mid} version {n} of the License, or
# (at your option) any later version."""
MORE = "\nYou should have received a copy of the GNU General Public License along with this program."


def test_standard_notices_get_their_version(spark, make_docs):
    either = ", either"
    texts = [NOTICE.format(name="", mid=either, n=3) + MORE, NOTICE.format(name="", mid=either, n=2) + MORE, NOTICE.format(name="", mid=";", n=2)]
    texts += ["you may use it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation."]
    texts += [NOTICE.format(name="Lesser ", mid=either, n=3) + MORE, "see the GNU General Public License" + MORE, "a plain text, version 3 of it"]
    got = {r.doc_id: r for r in scan_licences(spark, make_docs([(i, x, "s") for i, x in enumerate(texts)])).collect()}
    assert [got[i].labels for i in range(4)] == [["gpl-3"], ["gpl-2"], ["gpl-2"], ["gpl-2"]]
    assert "lgpl" in got[4].labels and not {"gpl-2", "gpl-3"} & set(got[4].labels)
    assert got[5].labels == got[6].labels == [] and min(got[i].score for i in range(4)) > 0.6
