"""Object literals of scripts: what JSON says, what scripts write beyond it, and what is none."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from resultlake.sources import loose, serp

JSON = st.recursive(st.none() | st.booleans() | st.integers(-(10**12), 10**12) | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=15)


@settings(max_examples=150, deadline=None)
@given(JSON, st.booleans())
def test_json_is_read_as_json(value, ascii_):
    text = json.dumps(value, ensure_ascii=ascii_)
    assert loose.Literal(text).value() == json.loads(text)


def test_what_scripts_write():
    assert loose.literals("var a = {x: 'it\\'s', \"y\": [1, 2,], /* c */ z: 0x1f, n: undefined, t: !0, // e\n w: {deep: .5}};") == [{"x": "it's", "y": [1, 2], "z": 31, "n": None, "t": True, "w": {"deep": 0.5}}]
    assert loose.literals("push([1, {q: '\\ud83d\\ude00'}]); b = [3]") == [[1, {"q": "😀"}], [3]]
    assert loose.literals("a = {b: c()}, d = {e: 1}") == [{"e": 1}]
    assert loose.literals("if (x) { y(); } for (;;) {}") == [] and loose.literals("a = {") == [] and loose.literals("") == []
    assert loose.literals("a = " + "[" * 5000) == []
    assert loose.literals("a = {outer: bad(), inner: {ok: 1}}") == [{"ok": 1}]
    assert serp.json_blocks(None) == [] and serp.json_blocks("<script>x = {a: '</p>'}</script>") == [{"a": "</p>"}]
