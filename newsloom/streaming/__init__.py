"""Continuous forms of the operators that run all the time; each equals its batch form on the same rows."""
