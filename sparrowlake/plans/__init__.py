"""sparrowlake.plans"""
