from catadrift.functions.text import lookup, normalise_pii, strip

__all__ = ["lookup", "normalise_pii", "strip"]
