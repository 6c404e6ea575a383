"""Operators for preparing training text: ten stand-alone modules over document tables."""
