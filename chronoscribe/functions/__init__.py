"""Column functions (Catalyst expressions unless a docstring says otherwise)."""
