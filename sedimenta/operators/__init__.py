"""Operators over journals, trees and intervals; each takes and returns DataFrames."""
