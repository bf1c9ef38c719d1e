"""Runnable jobs.  Each has a function that takes a session, and a command line that creates and stops one."""
