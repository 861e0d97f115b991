"""Texts that every operator has to bear."""

ODD = [None, "", " \t\n", "a", "a b c", "word " * 3_000, "é ü ß 日本 語 😀", "\u0001 ﻿ x", "A" * 50_000, "x\n" * 500]
