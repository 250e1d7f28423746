"""Training-data operators at corpus scale.

Nothing outside this subpackage imports it. ``queries.py`` registers one thin
query per operator; the operators keep their own general interfaces.
"""
