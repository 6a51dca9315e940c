"""Training-data operators (tokenising, search, sanitising, near-copies, chat, language,
suffixes, quality, licences, mixing). Nothing else in the library imports this subpackage.
"""
