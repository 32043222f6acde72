"""Readers. Parsers keep rejected rows beside the good ones instead of dropping them."""
