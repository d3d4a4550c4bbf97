"""Reserved: the library's operators are batch; permutation results accumulate by idempotent appends, see accumulate.py."""
