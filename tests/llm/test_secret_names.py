"""Novel secrets behind names, in unquoted assignments, and without digits."""

import pytest

from pageforge.llm import secrets

VALUE = "Zx9Kq2Lm8Vt4Rw7Yb3Nc6Hd1Jf5Gs0Pa"


@pytest.mark.parametrize("text, value", [
    ("export AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"),
    (f"SERVICE_AUTH={VALUE}==", f"{VALUE}=="),
    (f"password is '{VALUE}'", VALUE),
    (f"passwd -> '{VALUE}'", VALUE),
    (f"api_key => '{VALUE}'", VALUE),
    (f"apikey => '{VALUE}'", VALUE),
    ("the private key: QzXvKjWqPbGhTnRmLcYd", "QzXvKjWqPbGhTnRmLcYd"),
])
def test_found(text, value):
    assert [text[s:e] for s, k, e in secrets.spans(text) if k == 3] == [value]


@pytest.mark.parametrize("text", [f"keyboard {VALUE}", "AUTH_HANDLER=connection_factory_identifier_repository", "access theIdentifierHandlerFactoryConnection now"])
def test_not_found(text):
    assert not secrets.spans(text)
