"""Writers of histories in other tools' formats."""
