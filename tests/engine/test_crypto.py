import pytest

from quire.sources import crypto as cr
from quire.sources import document as dc
from quire.sources.syntax import Ref


def test_known_vectors():
    assert cr.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    cr._tables()
    keys = cr._round_keys(bytes(range(16)))
    block = bytes.fromhex("00112233445566778899aabbccddeeff")
    assert cr.aes_block(keys, block, False).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert cr.aes_block(keys, cr.aes_block(keys, block, False), True) == block
    assert cr.aes_cbc(bytes(16), cr.aes_cbc(bytes(16), b"hello", False), True) == b"hello"


@pytest.mark.parametrize("aes", [False, True])
def test_protected_documents(aes):
    plain = dc.Document(dc.from_pages([[(72, 700, "secret text")]], "T"))
    objects = {n: plain.get(Ref(n)) for n in plain.entries if plain.get(Ref(n)) is not None}
    locked, encrypt = cr.protect(objects, b"user", b"owner", b"0123456789abcdef", aes)
    data = dc.build(locked, 1, 4, compress=False, more={"Encrypt": encrypt, "ID": [b"0123456789abcdef"] * 2})
    assert b"secret text" not in data
    for word, role in ((b"user", "user"), (b"owner", "owner"), (b"wrong", None)):
        d = dc.Document(data, password=word)
        assert d.handler.role == role
        if role:
            assert "".join(g.unicode for g in dc.interpret(d, d.pages()[0][1])[0]) == "secret text" and d.metadata() == {"Title": "T"}
