"""Training-data operators: ten stand-alone operators over documents and conversations.

Nothing outside this subpackage imports it; it may be removed as a whole.
"""
