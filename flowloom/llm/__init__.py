"""Operators of a training-data pipeline; nothing else in the library imports them.

``plans`` registers their queries; the modules hold one operator each.
"""
